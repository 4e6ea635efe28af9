import gzip
import hashlib

import pytest
from cases import rows_of

from shelfwise.llm import warc
from shelfwise.session import new_path, small_table

HTML = "<p>é" + "x" * 120 + "</p>"
PAGES = [
    (1, "http://a/1", HTML), (2, "http://a/2\r\nX-Evil: 1", HTML), (3, None, HTML), (None, "http://n", HTML),
    (4, "http://b", None), (5, "http://b", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "WARC/1.1\r\n\r\n" * 30),
    (8, "u", "WARC/1.1\r\n\r\n" * 30), (9, "", "y" * 300_000), (10, "é", "y" * 300_000), (11, "q", "z" * 100), (10, "é", "z" * 99),
]


@pytest.fixture(scope="module")
def pages(spark):
    return small_table(spark, "page_id long, url string, html string", PAGES).selectExpr(
        "*", "'c' AS payload", "'c' AS record_type", "'c' AS n"
    )


def brute():
    def digest(h):
        return hashlib.sha256((h or "").encode()).hexdigest()

    out = []
    for i, _, h in PAGES:
        n = len((h or "").encode())
        same = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None] if n >= 100 else []
        first = min(same, default=None)
        revisit = first is not None and first != i
        out.append((i, n, digest(h), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, pages):
    assert rows_of(warc.warc_round_trip(spark, pages)) == brute()
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_payloads_predicates_and_splits(spark, pages, capsys):
    path = new_path(spark, "warc-test")
    warc.write_archive(warc.records(pages).coalesce(1), path, split_bytes=500)
    whole = warc.read_archive(spark, path)
    assert whole.rdd.getNumPartitions() > 3
    texts = {(r.page_id, bytes(r.payload).decode()) for r in whole.where("record_type = 'response'").collect()}
    assert (9, "y" * 300_000) in texts and (8, "WARC/1.1\r\n\r\n" * 30) in texts and (4, "") in texts
    some = warc.read_archive(spark, path).where("page_id > 5 AND page_id <= 9 AND record_type IN ('response')")
    some.explain("formatted")
    assert "GreaterThan(page_id,5)" in capsys.readouterr().out.split("PushedFilters:")[1].split("\n")[0]
    assert sorted(r.page_id for r in some.collect()) == [6, 7, 8, 8, 9]
    assert warc.read_archive(spark, path).where("page_id IS NULL").count() == 1
    assert warc.read_archive(spark, path).where("target_uri = 'http://a/2%0D%0AX-Evil: 1'").count() == 1


def test_unwanted_payloads_are_not_decoded(spark, pages, monkeypatch):
    path = new_path(spark, "warc-skip")
    warc.write_archive(warc.records(pages).coalesce(1), path)
    reader = warc.WarcReader(path)
    assert list(reader.pushFilters([warc.EqualTo(("page_id",), 6), warc.EqualTo(("payload",), b"")])) == [
        warc.EqualTo(("payload",), b"")
    ]
    seen, real = [], warc.decoded
    monkeypatch.setattr(warc, "decoded", lambda block: seen.append(1) or real(block))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == [b"short"] and len(seen) == 1


def test_compressed_archives_of_other_origin(spark, tmp_path):
    row = {"record_type": "response", "page_id": 1, "target_uri": "u", "payload_digest": "d", "payload_bytes": 2, "refers_to": None}
    records = [warc.record_bytes(row | {"page_id": i, "payload": b"x" * (9000 * i)}) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = warc.read_archive(spark, str(tmp_path)).selectExpr("page_id", "length(payload) n")
    assert rows_of(got) == sorted([(i, 9000 * i) for i in range(4)] * 2, key=repr)
    one = warc.read_archive(spark, str(tmp_path)).where("page_id = 3").selectExpr("length(payload) n")
    assert rows_of(one) == [(27000,), (27000,)]


def test_later_writes_add_records(spark, pages):
    path = new_path(spark, "warc-twice")
    warc.write_archive(warc.records(pages.where("page_id = 6")), path)
    warc.write_archive(warc.records(pages.where("page_id = 11")), path)
    assert sorted(r.page_id for r in warc.read_archive(spark, path).collect()) == [6, 11]


def test_records_of_every_kind(spark, tmp_path):
    def record(kind, block, content):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    get = b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"
    held = [
        record("warcinfo", b"software: x", "application/warc-fields"), record("request", get, "application/http;msgtype=request"),
        record("resource", b"\x00raw", "image/png"), record("conversion", "t\u00e9xt".encode(), "text/plain"),
        record("metadata", b"", "application/warc-fields"), record("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "application/http"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(held))
    got = {r.record_type: bytes(r.payload) for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert got == {
        "warcinfo": b"software: x", "request": b"", "resource": b"\x00raw", "conversion": "t\u00e9xt".encode(), "metadata": b"",
        "response": b"body",
    }

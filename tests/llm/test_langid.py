import zlib

from cases import no_docs, odd_docs

from shelfwise.llm import langid
from shelfwise.llm.common import table
from shelfwise.session import small_table

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR, "documents")
    got = langid.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    kept = [r for r in held if not r.rejected]
    assert len(kept) / len(held) > 0.97
    assert sum(r.lang == r.lang_pred for r in kept) >= 0.98 * len(kept)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = table(spark, SF_DIR, "documents")
    lies = docs.withColumn("lang", langid.F.when(langid.remainder() == 1, "xx").otherwise(docs.lang))
    one, two = (sorted(map(tuple, langid.identify_language(d).collect())) for d in (docs, lies))
    assert one == two


def test_odd_cases(spark):
    docs = odd_docs(spark)
    got = {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in langid.identify_language(docs).collect()}
    for i in (100, 101, 102, 103):
        assert (i, "und", 0.0, True) in got
    assert {p for _, p, *_ in got} <= {"en", "de", "fr", "und"}
    assert langid.identify_language(no_docs(spark)).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR doc_id IN (101, 102, 103)").count() == 0
    unlabelled = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_language(unlabelled).collect()} == {"und"}


def test_long_text_counts_as_a_whole(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text", "lang")
    texts = {lang: [r.text for r in docs.where(f"lang = '{lang}'").limit(40).collect()] for lang in ("fr", "de")}
    mixed = " ".join(texts["fr"])[:8000] + "\n" + " ".join(texts["de"])[:80000]
    long = small_table(spark, "doc_id long, text string, lang string", [(10**6, mixed, None)])
    got = langid.identify_language(docs.unionByName(long)).where("doc_id = 1000000").first()
    assert got.lang_pred == "de" and not got.rejected

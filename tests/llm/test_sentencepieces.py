"""Encoding against the library's own, with several character maps; spans against the library's offsets."""

import hashlib
import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from cases import no_docs, odd_docs

from shelfwise.llm import queries
from shelfwise.llm.common import table
from shelfwise.llm.sentencepieces import Tokenizer, encode_texts
from shelfwise.session import small_table

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as held:
    MODEL = held.read()
ODD = ["", "a", " ", "  x ", "   ", "Hé 𐍈ก", "a\0b", "▁a  b▁", "\n\t x\r\n", "<s> </s> <unk> <0x41>", "é é ệ  ́x", "🙂" * 30]
ALPHABET = list("aAeé  \t\n　ｆﬁ①̣̂́ขคำ가가​\xad▁𐍈²½ÅÅ\0\x01﻿¨´")


def with_rules(rule: str, *flags: int) -> bytes:
    """The model with a compiled map and its flags: leading space, spaces collapsed, spaces escaped."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    spec += b"".join(bytes([number << 3, flag]) for number, flag in zip((3, 4, 5), flags))
    size, left = b"", len(spec)
    while left > 127:
        size, left = size + bytes([left & 127 | 128]), left >> 7
    return MODEL + b"\x1a" + size + bytes([left]) + spec


def check(tokenizer, text):
    ids, starts, ends = tokenizer.encode(text, end_id=False)
    want = tokenizer.whole.encode_as_proto(text).pieces
    assert ids.tolist() == [p.id for p in want], text
    assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], text


def test_odd_texts_and_given_documents(spark):
    tokenizer = Tokenizer(MODEL)
    for text in ODD + [r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]:
        check(tokenizer, text)
        ids = tokenizer.encode(text)[0].tolist()
        assert ids == tokenizer.whole.encode(text, add_eos=True) and tokenizer.decode(ids) == tokenizer.whole.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_compiled_character_maps(rule):
    rnd = random.Random(rule)
    for flags in itertools.product((0, 1), repeat=3):
        tokenizer = Tokenizer(with_rules(rule, *flags))
        for text in ODD + ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 14))) for _ in range(150)]:
            check(tokenizer, text)


def test_spans_cover_the_source():
    tokenizer = Tokenizer(with_rules("nmt_nfkc", 1, 1, 1))
    text = "ｈｅ ﬁn  ①é"
    source = text.encode()
    ids, starts, ends = tokenizer.encode(text)
    cut = [source[a:b].decode() for a, b in zip(starts, ends)]
    assert "".join(cut).replace(" ", "") == text.replace(" ", "")
    assert ids[-1] == tokenizer.whole.eos_id() and starts[-1] == ends[-1] == len(source)


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = odd_docs(spark)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode_texts(docs, PATH).collect()), key=repr)
    coded = [(r.doc_id, library.encode(r.text or "", add_eos=True)) for r in docs.collect()]
    assert got == sorted(((i, ids, library.decode(ids)) for i, ids in coded), key=repr)
    assert encode_texts(no_docs(spark), PATH).count() == 0
    long = small_table(spark, "doc_id string, text string", [("a", "Über naïve ﬁ " * 100_000)])
    assert len(encode_texts(long, PATH).first().ids) == len(library.encode("Über naïve ﬁ " * 100_000)) + 1


def test_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = queries.op11_sentencepiece(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)

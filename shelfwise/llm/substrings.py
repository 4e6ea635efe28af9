"""Substring dedup with suffix automata.

A window of 20 words is removed where its words also start earlier in the corpus.
Pieces that share an anchor (``repeats``) form a reference shard. A task walks
its shards in corpus order: each piece is streamed through the shard's suffix
automaton for matching statistics, the length of the longest earlier match that
ends at each word; where it reaches 20, the window that ends there repeats. Then
the piece is added. Only shards that share an anchor with a document meet it:
sending every automaton to every document would take shards times documents.

Defined results: a null text has no words; a null doc_id comes before all
others; repeated rows are one document and get equal rows; rows that repeat an id
with other texts are ordered by a hash of the text; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm.repeats import Windows, merged, repeated_spans, with_spans

WINDOW = 20
WORDS = Windows(length=WINDOW, gram=5, words=True, most=2000)


class Automaton:
    """The suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of ``p`` extended by ``word``, when ``q`` stands for longer strings too."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # the string is there from an earlier sequence
                last = self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def matches(self, words) -> Iterator[int]:
        """For each word, how long the longest suffix of what was read so far is that occurs."""
        at, length = 0, 0
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                length += 1
            else:
                length = 0
            yield length


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that an earlier piece of the same anchor holds."""
    anchor, shard = None, Automaton()
    for batch in batches:
        found = []
        for a, _, key, at, _, _, text in zip(*[c.to_pylist() for c in batch.columns]):
            if a != anchor:
                anchor, shard = a, Automaton()
            words, begin = text.split(), None
            for i, length in enumerate(shard.matches(words)):
                if length >= WINDOW:
                    if begin is None:
                        begin = i + 1 - WINDOW
                elif begin is not None:
                    found.append((key, at + begin, at + i))
                    begin = None
            if begin is not None:
                found.append((key, at + begin, at + len(words)))
            if begin != 0:
                shard.add(words)
        columns = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "start", "end"])


def repeated_words(docs: DataFrame, spec: Windows = WORDS) -> DataFrame:
    """Per document with any: ``key`` and the spans of words that earlier text repeats."""
    return repeated_spans(docs, spec, compare, "substring", keep_first=True)


def dedup_substrings(docs: DataFrame, spec: Windows = WORDS) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed``, the words that stay joined by spaces and their SHA-256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                words = (text or b"").split()
                kept, at = [], 0
                for start, end in merged(spans, len(words)):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                joined = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = with_spans(docs, repeated_words(docs, spec)).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text", "spans")
    out = rows.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")
    return out.selectExpr("doc_id", "n_words", "n_removed", "kept_sha256", "CAST(kept AS STRING) kept")

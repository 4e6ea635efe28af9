"""SentencePiece encoding that knows the source bytes of every piece, and decoding.

A text is normalised first: at each place the longest prefix that the model's
compiled character map holds is replaced, and every byte of the result keeps the
place in the source that it came from. The pieces of the normalised text are then
projected through that alignment to spans of source bytes. The merges themselves
are the library's, run on a copy of the model that normalises nothing; decoding is
the library's on the model as it is.

Defined results: a null text is empty; an empty text has the end id alone; a
character that falls back to bytes gives its span to its last byte piece, the ones
before it are empty, as are the end id's and the leading space's; repeated rows get
equal rows; an empty table gives no rows. A text is always encoded whole.
"""

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from shelfwise.llm.common import groups_by_bytes

SPACE = "▁".encode()  # fixed value: how the models write a space
REPLACEMENT = "�".encode()
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6  # fixed values: types of pieces in the model file
PART_BYTES = 4 << 20  # of texts that go into one batch of results


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message, in order: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double array over UTF-8 prefixes, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = blob[4 + size :]

    def _children(self, node: int) -> dict[int, int]:
        units, base = self.units, node ^ self._offset(node)
        at = np.arange(256) ^ base
        inside = np.flatnonzero(at < len(units))
        hit = inside[(units[at[inside]] & ((1 << 31) | 255)) == inside]
        return {int(b): int(at[b]) for b in hit if b}

    def _offset(self, node: int) -> int:
        unit = int(self.units[node])
        return (unit >> 10) << ((unit >> 6) & 8)

    @cached_property
    def starts(self) -> np.ndarray:
        """Whether a rule may start with two given bytes, by their number ``256 * first + second``."""
        may = np.zeros((256, 256), bool)
        for first, node in self._children(0).items():
            if self.units[node] >> 8 & 1:
                may[first] = True
            may[first, list(self._children(node))] = True
        return may.ravel()

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest rule that ``text`` has at ``at``, and what replaces them."""
        node, found = self._offset(0), None
        for length in range(1, len(text) - at + 1):
            node ^= text[at + length - 1]
            if node >= len(self.units) or self.units[node] & ((1 << 31) | 255) != text[at + length - 1]:
                break
            leaf = bool(self.units[node] >> 8 & 1)
            node ^= self._offset(node)
            if leaf:
                begin = int(self.units[node]) & ((1 << 31) - 1)
                found = length, self.texts[begin : self.texts.index(0, begin)]
        return found


class Normalizer:
    """Texts as a model wants them, with the source place of every byte."""

    def __init__(self, spec: bytes, protected: list[bytes] = (), suffix: bool = False):
        given = dict(fields(spec))
        charsmap = given.get(2, b"")
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy, self.collapse, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.protected = sorted(protected, key=len, reverse=True)

    def _replaced(self, text: bytes, data: np.ndarray, first: np.ndarray):
        """``(start, end, replacement)`` of each stretch that a rule changes; protected pieces stay as they are."""
        may = np.zeros(len(data), bool)
        if self.map is not None:
            after = np.append(data[1:], 0)
            may = self.map.starts[data.astype(np.int64) * 256 + after]
        if self.protected:
            may |= np.isin(data, [p[0] for p in self.protected])
        done = 0
        for at in np.flatnonzero(may & first).tolist():
            if at < done:
                continue
            kept = next((p for p in self.protected if text.startswith(p, at)), None)
            if kept is not None:
                yield at, at + len(kept), kept
                done = at + len(kept)
            elif self.map is not None and (found := self.map.longest(text, at)):
                yield at, at + found[0], found[1]
                done = at + found[0]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the place in ``text``."""
        if not text:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(text, np.uint8)
        first = (data & 0xC0) != 0x80
        start = np.maximum.accumulate(np.where(first, np.arange(len(data)), 0)).astype(np.int64)
        bytes_, places, units, at, gone = [], [], [], 0, None
        for begin, end, new in self._replaced(text, data, first):
            if gone is None and not new:
                gone = begin
            bytes_ += [data[at:begin], np.frombuffer(new, np.uint8)]
            places += [start[at:begin], np.full(len(new), begin)]
            units += [first[at:begin], np.arange(len(new)) == 0]
            at = end
        if bytes_:
            data, start, first = (np.concatenate([*held, rest[at:]]) for held, rest in ((bytes_, data), (places, start), (units, first)))
        head, end = 0, len(text)
        if self.collapse:
            data, start, head = self._collapsed(data, start, first)
            head = min((h for h in (head, gone) if h is not None), default=None)
            if head is None:
                return b"", np.zeros(1, np.int64)
        space = SPACE if self.escape else b" "
        lead, tail = (space, b"") if self.dummy and not self.suffix else (b"", space if self.dummy else b"")
        spaces = data == 0x20
        width = np.where(spaces, len(space), 1)
        out, origin = np.repeat(data, width), np.repeat(start, width)
        if self.escape and spaces.any():
            put = (np.cumsum(width) - width)[spaces]
            for k, byte in enumerate(SPACE):
                out[put + k] = byte
        done, origin = lead + out.tobytes(), np.concatenate((np.full(len(lead), head), origin, [end]))
        while self.collapse and done.endswith(space):
            done = done[: -len(space)]
            origin = origin[: len(done) + 1]
        return done + tail, np.concatenate((origin, np.full(len(tail), origin[-1])))

    @staticmethod
    def _collapsed(data, start, first):
        """Without the spaces that open a unit (a character or a replacement) after a space or at the front.

        Also where the first unit that is not a plain space starts, if there is one.
        """
        opens = np.flatnonzero(first)
        size = np.diff(np.append(opens, len(data)))
        spaces = data == 0x20
        plain = spaces[opens] & (size == 1)
        rest = np.flatnonzero(~plain)
        head = int(start[opens[rest[0]]]) if len(rest) else None
        after = np.append(True, spaces[opens[1:] - 1])[: len(opens)]
        others = np.cumsum(~spaces)
        before = np.repeat(others[opens] - ~spaces[opens], size)
        gone = spaces & (others == before) & np.repeat(after, size)
        return data[~gone], start[~gone], head


class Tokenizer:
    """A model file's encoder, with offsets, and decoder."""

    def __init__(self, model: bytes):
        pieces, spec, suffix = [], b"", False
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece.get(1, b""), piece.get(3, 1)))
            elif number == 2:
                suffix = bool(dict(fields(value)).get(24, 0))
            elif number == 3:
                spec += value
        self.normalize = Normalizer(spec, [p for p, kind in pieces if kind == USER], suffix)
        self.sizes = np.array([{BYTE: 1, CONTROL: 0}.get(kind, len(p)) for p, kind in pieces], np.int64)
        self.unknown = next(i for i, (_, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the later of two normaliser fields wins: no map, no leading space, spaces as they are
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")

    def encode(self, text: str, end_id: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source bytes that each piece starts and ends at."""
        source = text.encode()
        normal, origin = self.normalize(source)
        ids = np.asarray(self.plain.encode_as_numpy(normal.decode()), np.int64)
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():  # stands for stretches of any length
            sizes = np.array([p.end - p.begin for p in self.plain.encode_as_proto(normal.decode()).pieces], np.int64)
        ends = np.cumsum(sizes)
        starts, stops = origin[ends - sizes], origin[ends]
        if end_id:
            ids = np.append(ids, self.whole.eos_id())
            starts, stops = np.append(starts, len(source)), np.append(stops, len(source))
        return ids, starts, stops

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


def encode_texts(docs: DataFrame, model_path: str, end_id: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, the ``ids``, the source bytes where each piece ``starts`` and ``ends``, and ids ``decoded``.

    The model file is read once, here, and goes to the tasks as it is; its size does not depend on the data.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(model.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in groups_by_bytes([len(t) for t in texts], PART_BYTES):
                found = [tokenizer.encode(t, end_id) for t in texts[part]]
                cuts = pa.array(np.cumsum([0, *(len(ids) for ids, _, _ in found)]), pa.int32())
                joined = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))]
                lists = [pa.ListArray.from_arrays(cuts, c) for c in joined]
                decoded = pa.array([tokenizer.decode(ids.tolist()) for ids, _, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(found)), *lists, decoded], ["key", "ids", "starts", "ends", "decoded"]
                )

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")
    return out.withColumnRenamed("key", key)

"""Quality rules as a learned decision list.

Texts are measured once. From labelled measurements, sequential covering grows
one conjunction of thresholds after another for bad texts, prunes it on rows it
was not grown on, and keeps it while it is precise. The list becomes one ordered
Spark conditional expression.

Learned from a bounded sample: at most ``SAMPLE_ROWS`` labelled rows, those with
the least hash of their id.

Defined results: a null text has no words and fails the base rule; ratios of a
text without words are null, and a null fails every threshold; a null or
repeated label teaches nothing or each of its rows; with no labels the list is
empty and the base rule decides alone; repeated rows get equal rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import (
    IS_SPACE, WORD_BASE, WORD_INVERSE, Sums, byte_sums, groups_by_bytes, mixed, word_bounds,
)

WINDOW = 8
SAMPLE_ROWS = 20_000
LEAST_PRECISION, LEAST_COVERED, MOST_TERMS, MOST_RULES = 0.9, 10, 4, 12
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper",
    "n_distinct", "n_marks",
)
#: What thresholds are learned on, as SQL over the counts.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
    "words_per_line": "n_words / nullif(n_lines, 0)",
    "digit_share": "n_digits / nullif(word_chars, 0)",
    "upper_share": "n_upper / nullif(word_chars, 0)",
    "distinct_share": "n_distinct / nullif(n_words, 0)",
    "marks_per_word": "n_marks / nullif(n_words, 0)",
}


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _DIGIT, _MARK = _bytes("#*$%&|<>"), _bytes("0123456789"), _bytes(".!?,;:")
_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NEWLINE = 0x0A


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text, all texts at once."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)  # just past the line end that follows each text
    begins = ends - sizes - 1
    starts, stops = word_bounds(data)
    doc = np.searchsorted(ends, starts, side="right")
    n = len(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends - 1] - total[begins]

    def per_doc(where: np.ndarray) -> np.ndarray:
        return np.bincount(where, minlength=n)

    inside = ~IS_SPACE[data]
    sums = byte_sums(data)
    word = sums(starts, stops)
    own = mixed(doc.astype(np.uint64) + np.uint64(1))
    out = {
        "n_words": per_doc(doc), "word_chars": per_text(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]), "n_digits": per_text(_DIGIT[data]), "n_upper": per_text(_UPPER[data]),
        "n_marks": per_text(_MARK[data]),
    }
    _, first = np.unique(word ^ own, return_index=True)
    out["n_distinct"] = per_doc(doc[first])

    line_ends = np.flatnonzero(data == _NEWLINE)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    words_before = np.concatenate(([0], np.cumsum(inside)))
    real = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[real], line_ends[real]
    line_doc = np.searchsorted(ends, line_starts, side="right")
    line = sums(line_starts, line_ends) ^ mixed(line_doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line, return_index=True)
    out["n_lines"] = per_doc(line_doc)
    out["n_dup_lines"] = out["n_lines"] - per_doc(line_doc[first])

    repeat = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        at = np.arange(len(word) - WINDOW + 1)
        at = at[doc[at] == doc[at + WINDOW - 1]]
        window = Sums(word, WORD_BASE, WORD_INVERSE)(at, at + WINDOW) ^ own[at]
        _, same, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = at[times[same] > 1]
        repeat[twice] += 1
        repeat[twice + WINDOW] -= 1
    out["n_repeat_words"] = per_doc(doc[np.cumsum(repeat[:-1]) > 0])
    return out


def measured(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id`` and the counts of its text."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            for part in groups_by_bytes([len(t) for t in texts]):
                found = counts(texts[part])
                columns = [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *columns], schema=schema)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(measure, ", ".join(f"{f.name} bigint" for f in schema))


def features(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.expr(sql).cast("double").alias(f"f_{name}") for name, sql in FEATURES.items()])


@dataclass(frozen=True)
class Term:
    """``feature >= bound`` or ``feature < bound``; a missing value fails both."""

    feature: str
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return x >= self.bound if self.above else x < self.bound

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value >= F.lit(self.bound) if self.above else value < F.lit(self.bound)

    def __str__(self):
        return f"{self.feature} {'>=' if self.above else '<'} {self.bound:.6g}"


def _covered(rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for term in rule:
        hit &= term.holds(data[term.feature])
    return hit


def _grown(data, bad, most_terms):
    """Add the threshold with the largest gain in information until only bad rows are covered."""
    rule, hit = [], np.ones(len(bad), bool)
    while len(rule) < most_terms:
        p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p0 or not n0:
            break
        now, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, x in data.items():
            seen = x[hit & ~np.isnan(x)]
            if not len(seen):
                continue
            for bound in np.unique(np.quantile(seen, np.linspace(0.01, 0.99, 99))):
                for above in (True, False):
                    term = Term(name, above, float(bound))
                    both = hit & term.holds(x)
                    p, n = int((both & bad).sum()), int((both & ~bad).sum())
                    if p and (gain := p * (np.log2(p / (p + n)) - now)) > best[0] + 1e-9:
                        best = (gain, term)
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].holds(data[best[1].feature])
    return rule


def _pruned(rule, data, bad):
    """Drop last terms while that does not lower (p - n) / (p + n) on rows the rule was not grown on."""

    def worth(terms):
        hit = _covered(terms, data, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(
    data: dict[str, np.ndarray], bad: np.ndarray, least_precision=LEAST_PRECISION, least_covered=LEAST_COVERED,
    most_terms=MOST_TERMS, most_rules=MOST_RULES,
) -> list[list[Term]]:
    """Conjunctions for bad rows, in the order they were found; two thirds of the rows grow, a third prunes."""
    rules, left = [], np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules:
        grow, prune = left & ~third, left & third
        if not (bad & grow).any() or not prune.any():
            break
        rule = _grown({k: v[grow] for k, v in data.items()}, bad[grow], most_terms)
        if not rule:
            break
        rule = _pruned(rule, {k: v[prune] for k, v in data.items()}, bad[prune])
        hit = _covered(rule, data, len(bad)) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        held_out = _covered(rule, data, len(bad)) & prune
        hp, hn = int((held_out & bad).sum()), int((held_out & ~bad).sum())
        if p < least_covered or p / (p + n) < least_precision or (hp + hn and hp / (hp + hn) < least_precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[Term]]) -> Column:
    """The number of the first rule that a row meets, from 1; 0 for none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        condition = rule[0].column()
        for term in rule[1:]:
            condition = condition & term.column()
        out = F.when(condition, F.lit(i)).otherwise(out)
    return out


def learn_from(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Term]]:
    """Rules from the measurements of a bounded sample of labelled documents, which are numbers only."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = (
        features(measured(texts)).join(F.broadcast(sample), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "n_words", "word_chars", "quality").limit(sample_rows)
    )
    names = list(FEATURES)
    table = rows.select("quality", *[f"f_{n}" for n in names]).toPandas()
    data = {n: table[f"f_{n}"].to_numpy(np.float64, na_value=np.nan) for n in names}
    return learn_rules(data, table["quality"].to_numpy() == 0)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: the contract's counts, ``base_failed``, ``kept`` and the rule that dropped it."""
    rule = verdict(learn_from(docs, labels))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = features(measured(docs)).withColumn("base_failed", failed).withColumn("rule", rule)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )

"""Exact nearest neighbours for a batch of queries over a table of any size.

Items are never shuffled and pairs are never written out: each task scores its
own Arrow batches against the query batch with one matrix product and keeps the
best rows per query, so a task sends at most ``fetch`` rows per query to the
final ranking. A query batch beyond the bound of one pass meets the items block
by block, through one shuffle that deals blocks of items and groups of queries to
tasks of bounded work.
"""

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.operators.filters import VALUE_KEYS, strip_lower
from shelfwise.operators.payload import ROW_BITS, on_first_row, packed
from shelfwise.schemas import FILTERS
from shelfwise.session import checkpointed

# The scoring code travels with the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASS_QUERIES = 4096  # queries scored in one pass over the items
PASS_ROWS = 1 << 21  # rows kept per task and pass: queries x fetch
BLOCK_BYTES = 64 << 20  # vectors of the items that a task holds, where queries are too many for one pass
QUERY_BYTES = 64 << 20  # vectors of the queries that are streamed past them
TASK_PRODUCTS = 1 << 37  # products of two numbers in a task: some 46,000 items by as many queries of 64 numbers
CHUNK_QUERIES = 1024  # queries that meet a block of items at once
BLOCK_CELLS = 1 << 20  # scores held at once in a task
FIRST_ROWS = 256  # items scored first, for a floor; the next stretches grow
SINGLE_LENGTH = 1e15  # of a vector, at most, to be compared in single precision first
SCORE_DIGITS = 12  # equal vectors must tie whatever block they fall in
SCAN_VALUES = 256  # of a text column, that a scan is asked for; batches that ask for more are not cut by it

_ITEM_OPTIONAL = {"price": "double", "points": "double", "variety": "string", "country": "string", "cluster": "int"}


def nearest(
    items: DataFrame,
    queries: DataFrame,
    size: tuple[int, int] | None = None,
    pass_queries: int = PASS_QUERIES,
    cosine: bool = False,
) -> DataFrame:
    """The best ``fetch`` items per query, ranked.

    ``items`` has ``item_id`` and ``embedding``, and for filters and column
    orders also ``price``, ``points``, ``variety`` and ``country``. ``queries``
    has ``query_id``, ``vector`` and ``fetch``, and optionally

    * ``filters``: only items that meet them are ranked for this query;
    * ``exclude_id``: an item left out of the ranking;
    * ``floor``: a similarity that ``fetch`` of its items are known to reach, where it ranks by similarity;
    * ``clusters``: the values of the item column ``cluster`` that can hold its best items, see ``clusters``;
    * ``sort_by`` and ``ascending``: rank by this column (missing values last)
      instead of by similarity, which then breaks ties.

    ``size`` is (number of queries, largest fetch), counted here if not given.
    Similarity is the inner product; ``cosine`` divides by the vector lengths,
    for vectors that are not of unit length. The result has ``query_id, item_id, similarity, position``.
    """
    scored = score_partitions(items, queries, size, pass_queries, cosine=cosine)
    order = Window.partitionBy("query_id").orderBy(
        F.desc("sort_key"), F.desc("similarity"), F.asc("item_id")
    )
    ranked = scored.withColumn("position", F.row_number().over(order))
    return ranked.where("position <= fetch").select("query_id", "item_id", "similarity", "position")


def score_partitions(
    items: DataFrame,
    queries: DataFrame,
    size: tuple[int, int] | None = None,
    pass_queries: int = PASS_QUERIES,
    carry=(),
    cosine: bool = False,
) -> DataFrame:
    """Per task and query, the best ``fetch`` rows; ``carry`` query columns ride along."""
    by_cluster = "clusters" in queries.columns
    queries = _complete_queries(queries, carry)
    if size is None:
        pool = F.struct(*_BOUNDS, *VALUE_KEYS)
        found = queries.agg(F.count(F.lit(1)), F.max("fetch"), *loosest_bounds(pool)).first()
        size = (found[0], found[1] or 0)
        items = within_bounds(items, found, queries, pool)
    n, fetch = size
    if n <= min(pass_queries, PASS_ROWS // max(fetch, 1)):
        return _one_pass(items, queries, carry, cosine)
    return _block_join(items, queries, fetch, carry, cosine, by_cluster)


# Which item column a filter bounds, the loosest of several bounds, and the test.
_BOUNDS = {
    "price_min": ("price", F.min, lambda c, v: c >= v),
    "price_max": ("price", F.max, lambda c, v: c <= v),
    "min_points": ("points", F.min, lambda c, v: c >= v),
}


def loosest_bounds(filters: Column) -> list[Column]:
    """What all queries of a batch have in common, for one aggregate over them.

    Per bound its loosest value, null unless every query has it; per text column whether every query asks for a value.
    """
    bounds = [
        F.when(F.count(filters[name]) == F.count(F.lit(1)), loosest(filters[name])).alias(name)
        for name, (_, loosest, _) in _BOUNDS.items()
    ]
    return bounds + [F.coalesce(F.every(filters[name].isNotNull()), F.lit(False)).alias(name) for name in VALUE_KEYS]


def within_bounds(items: DataFrame, bounds, queries: DataFrame, filters: Column) -> DataFrame:
    """The items that some query may rank, by tests that reach the scan; ``bounds`` as ``loosest_bounds`` gives them.

    Where every query asks for a value of a text column, the few different ones
    are gathered. They reach the scan where items are stored with the column in
    its compared form, as ``build_items`` does.
    """
    for name, (column, _, test) in _BOUNDS.items():
        if bounds[name] is not None and column in items.columns:
            items = items.where(test(F.col(column), F.lit(bounds[name])))
    for name, key in VALUE_KEYS.items():
        if bounds[name] and name in items.columns:
            asked = queries.select(F.lower(filters[name]).alias("v")).distinct().limit(SCAN_VALUES + 1).collect()
            if len(asked) <= SCAN_VALUES:
                have = F.col(key) if key in items.columns else strip_lower(F.col(name))
                items = items.where(have.isin(sorted(row.v for row in asked)))
    return items


def _complete_queries(queries: DataFrame, carry) -> DataFrame:
    have = set(queries.columns)

    def column(name: str, kind: str):
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    filters = F.col("filters") if "filters" in have else F.lit(None).cast(FILTERS)
    return queries.select(
        "query_id",
        F.col("vector").cast("array<double>").alias("vector"),
        F.col("fetch").cast("int").alias("fetch"),
        column("exclude_id", "long"),
        column("sort_by", "string"),
        column("ascending", "boolean"),
        filters["price_min"].cast("double").alias("price_min"),
        filters["price_max"].cast("double").alias("price_max"),
        filters["min_points"].cast("double").alias("min_points"),
        F.lower(filters["variety"]).alias("variety"),
        F.lower(filters["country"]).alias("country"),
        column("clusters", "array<int>"),
        column("floor", "double"),
        *carry,
    ).where("vector is not null and fetch > 0")


def _item_columns(items: DataFrame) -> list[Column]:
    def optional(name: str, kind: str):
        if name not in items.columns:
            return F.lit(None).cast(kind).alias(name)
        value = F.col(name)
        return (strip_lower(value) if kind == "string" else value.cast(kind)).alias(name)

    return ["item_id", "embedding", *[optional(name, kind) for name, kind in _ITEM_OPTIONAL.items()]]


def _result_schema(queries: DataFrame, carry) -> T.StructType:
    fields = {f.name: f for f in queries.schema}
    return T.StructType(
        [
            fields["query_id"],
            T.StructField("item_id", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("sort_key", T.DoubleType()),
            T.StructField("price", T.DoubleType()),
            T.StructField("points", T.DoubleType()),
            fields["fetch"],
            *[fields[c] for c in carry],
        ]
    )


def _one_pass(items: DataFrame, queries: DataFrame, carry, cosine: bool) -> DataFrame:
    rows = items.select(*_item_columns(items), on_first_row(packed(queries)).alias("queries"))
    schema = _result_schema(queries, carry)
    passed = ("fetch", *carry)
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if best is None:
                best = _Best(batch.column("queries").slice(0, 1).flatten(), cosine)
            if best.count:
                best.take(batch.filter(pc.is_valid(batch.column("embedding"))))
        if best is not None and best.count:
            yield best.result(arrow_schema, passed)

    return rows.mapInArrow(run, schema)


def _cut(items: int, queries: int, dim: int) -> tuple[int, int]:
    """Into how many blocks the items and how many groups the queries are cut, so that no task does or holds more than its bound."""
    cells = max(1, TASK_PRODUCTS // dim)
    rows = max(1, min(BLOCK_BYTES // (8 * dim), max(math.isqrt(cells), cells // max(queries, 1))))
    blocks = max(1, math.ceil(items / rows))
    asked = max(1, min(QUERY_BYTES // (8 * dim), cells // max(1, min(rows, items))))
    return blocks, max(1, math.ceil(queries / asked))


def _block_join(items: DataFrame, queries: DataFrame, fetch: int, carry, cosine: bool, by_cluster: bool) -> DataFrame:
    """Any number of queries in one plan: blocks of items, each met by groups of queries, a chunk of them at a time.

    The queries are laid in chunks and the chunks in groups; a task has one block
    and one group. It holds the items of the block and streams the chunks past
    them. ``_cut`` bounds what a task holds, reads and computes, so with both
    sides grows the number of tasks, not a task. Every block is sent once for each
    group and every group once for each block. Queries that name clusters are laid
    by them, and so are the items of a block, so that a chunk wants few stretches of a block.
    """
    laid = queries.orderBy("clusters", F.xxhash64("query_id")) if by_cluster else queries
    numbered = checkpointed(laid.withColumn("_n", F.monotonically_increasing_id()))
    n, dim = numbered.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks, groups = _cut(items.count(), n, dim or 1)
    size = max(1, min(CHUNK_QUERIES, PASS_ROWS // max(fetch, 1)))
    row = F.struct(*[F.col(c) for c in queries.columns])
    # ids count up within a partition, so a chunk has ``size`` queries at most
    part, nth = F.shiftright("_n", ROW_BITS), F.col("_n").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    chunks = numbered.groupBy(part.alias("part"), F.floor(nth / size).alias("nth")).agg(F.collect_list(row).alias("queries"))
    group = F.pmod(F.col("part") + F.col("nth"), F.lit(groups))

    def each(count: int):
        return F.explode(F.expr(f"sequence(0L, {count - 1}L)"))

    held = items.where("embedding is not null").select(
        (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) * groups).alias("_first"), F.lit(None).cast("long").alias("chunk"), *_item_columns(items),
    ).withColumn("_group", each(groups)).withColumn("cell", (F.col("_first") + F.col("_group")).cast("int")).drop("_first", "_group")
    chunk = F.shiftleft("part", ROW_BITS) + F.col("nth")
    sent = chunks.select(each(blocks).alias("block"), group.alias("group"), chunk.alias("chunk"), "queries").select(
        (F.col("block") * groups + F.col("group")).cast("int").alias("cell"), "chunk", "queries",
    )
    both = held.unionByName(sent, allowMissingColumns=True)
    # a hash would deal two cells to one task
    met = both.repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", F.asc_nulls_first("chunk"), "cluster")
    schema = _result_schema(queries, carry)
    passed = ("fetch", *carry)
    arrow_schema = to_arrow_schema(schema)

    def run(batches):
        cell, rows = None, []
        for batch in batches:
            cells_of = batch.column("cell").to_numpy()
            is_query = pc.is_valid(batch.column("chunk")).to_numpy(zero_copy_only=False)
            change = (cells_of[1:] != cells_of[:-1]) | is_query[1:] | is_query[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if cells_of[start] != cell:
                    cell, rows = cells_of[start], []
                part = batch.slice(start, end - start)
                if not is_query[start]:
                    rows.append(_prepared(part, cosine))
                elif rows:
                    best = _Best(part.column("queries").flatten(), cosine)
                    for items_of in rows:
                        best.take_items(items_of)
                    yield best.result(arrow_schema, passed)

    return met.mapInArrow(run, schema)


_POOL = ("price_min", "price_max", "min_points", "variety", "country")


def _coded(values: pa.Array):
    """A text column as numbers, -1 for missing, and the number of each value."""
    coded = pc.dictionary_encode(values.cast(pa.string()))
    numbers = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), numbers


def _meets(items, rule) -> np.ndarray:
    """The rows that pass every test of a pool; a missing value passes none."""
    good = np.ones(len(items["item_id"]), dtype=bool)
    if "price_min" in rule:
        good &= items["price"] >= rule["price_min"]
    if "price_max" in rule:
        good &= items["price"] <= rule["price_max"]
    if "min_points" in rule:
        good &= items["points"] >= rule["min_points"]
    for name in ("variety", "country"):
        if name in rule:
            codes, numbers = items[name]
            good &= codes == numbers.get(rule[name], -2)
    return good


def _scaled(vectors: np.ndarray, cosine: bool) -> np.ndarray:
    if not cosine:
        return vectors
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def _prepared(batch: pa.RecordBatch, cosine: bool) -> dict:
    """The columns of items as arrays, made once however many queries meet them; all have a vector."""
    column = {name: batch.column(name) for name in batch.schema.names}
    vectors = column["embedding"].flatten().to_numpy(zero_copy_only=False).astype("float64")
    vectors = _scaled(vectors.reshape(batch.num_rows, -1), cosine)
    with np.errstate(over="ignore"):
        singles = vectors.astype("float32")
    items = {
        "item_id": column["item_id"].to_numpy(zero_copy_only=False),
        "vectors": vectors, "singles": singles, "longest": np.linalg.norm(vectors, axis=1).max(initial=0.0),
        "price": column["price"].cast(pa.float64()).to_numpy(zero_copy_only=False),
        "points": column["points"].cast(pa.float64()).to_numpy(zero_copy_only=False),
        "variety": _coded(column["variety"]), "country": _coded(column["country"]),
    }
    if "cluster" in column:
        items["cluster"] = pc.fill_null(column["cluster"].cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return items


def _stretch(items: dict, start: int, end: int) -> dict:
    def cut(v):
        return (v[0][start:end], v[1]) if isinstance(v, tuple) else v[start:end] if isinstance(v, np.ndarray) else v

    return {name: cut(v) for name, v in items.items()}


class _Best:
    """The best rows so far for each query of one task."""

    def __init__(self, queries: pa.StructArray, cosine: bool):
        self.queries = queries
        self.cosine = cosine
        self.count = len(queries)
        if not self.count:
            return
        self.vectors = queries.field("vector").flatten().to_numpy(zero_copy_only=False)
        self.vectors = _scaled(self.vectors.reshape(self.count, -1), cosine)
        self.limit = queries.field("fetch").to_numpy(zero_copy_only=False)
        self.most = int(self.limit.max())
        columns = {name: queries.field(name).to_pylist() for name in ("exclude_id", "sort_by", "ascending", *_POOL)}
        pools: dict[tuple, list[int]] = {}
        for q, values in enumerate(zip(*[columns[name] for name in _POOL])):
            pools.setdefault(values, []).append(q)
        self.pools = [
            ({n: v for n, v in zip(_POOL, values) if v is not None}, np.array(own)) for values, own in pools.items()
        ]
        self.barred = pc.fill_null(queries.field("exclude_id").cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        self.has_barred = pc.is_valid(queries.field("exclude_id")).to_numpy(zero_copy_only=False)
        self.excluded = {q: v for q, v in enumerate(columns["exclude_id"]) if v is not None}
        self.orders = {q: (v, columns["ascending"][q]) for q, v in enumerate(columns["sort_by"]) if v is not None}
        self.live = self._live(queries.field("clusters")) if "clusters" in {f.name for f in queries.type} else {}
        self.cells = 0  # scores computed
        self.floor = np.full(self.count, -np.inf)
        if "floor" in {f.name for f in queries.type}:
            self.floor = pc.fill_null(queries.field("floor"), -np.inf).to_numpy(zero_copy_only=False).copy()
            self.floor[list(self.orders)] = -np.inf
        lengths = np.linalg.norm(self.vectors, axis=1)
        self.longest = lengths.max()
        # What a product in single precision can be off by, for an item of length 1: one rounding of each number, of
        # each product and of each sum, by Cauchy and Schwarz. The rest of the 16 covers double precision and rounded scores.
        self.off = lengths * (self.vectors.shape[1] + 16) * 2.0**-24
        with np.errstate(over="ignore"):
            self.singles = self.vectors.astype("float32")
        self.step = max(FIRST_ROWS, 16 * self.most)
        self._kept, self.waiting = _Rows.empty(), []

    def _live(self, clusters: pa.ListArray) -> dict:
        """Per cluster that some query names, which queries want it: those that name it, and those that name none."""
        if clusters.null_count == len(clusters):
            return {}
        self.anywhere = pc.is_null(clusters).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(clusters), 0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        named = pc.list_flatten(clusters).to_numpy()
        live = {}
        for c in np.unique(named).tolist():
            live[c] = self.anywhere.copy()
            live[c][of[named == c]] = True
        return live

    def take(self, batch: pa.RecordBatch):
        """Score the rows of a batch, all of which have a vector.

        Rows without one are dropped by the caller and not by a filter in the
        plan, which would compute an encoded vector twice.
        """
        if batch.num_rows:
            self.take_items(_prepared(batch, self.cosine))

    def take_items(self, items: dict):
        n, start, most = len(items["item_id"]), 0, max(1, BLOCK_CELLS // self.count)
        while start < n:
            step = min(self.step, most)
            self._take_block(_stretch(items, start, start + step))
            start, self.step = start + step, min(2 * self.step, most)

    def _take_block(self, items: dict):
        self.waiting += [self._scored(items, rows, queries) for rows, queries in self._meetings(items, len(items["item_id"]))]
        if sum(len(r.query) for r in self.waiting) > len(self._kept.query) // 4:
            self._settle()

    def _settle(self):
        if not self.waiting:
            return
        self._kept, self.waiting = self._kept.plus(*self.waiting).best(self.limit), []
        counts = np.bincount(self._kept.query, minlength=self.count)
        full = counts == self.limit
        last = np.cumsum(counts) - 1
        self.floor[full] = np.maximum(self.floor[full], self._kept.key[last[full]])

    @property
    def kept(self) -> "_Rows":
        self._settle()
        return self._kept

    def _meetings(self, items, n: int):
        """Which rows are scored for which queries: those of a pool, and of clusters that a query wants."""
        for rule, queries in self.pools:
            rows = np.flatnonzero(_meets(items, rule)) if rule else np.arange(n)
            if not len(rows):
                continue
            if not self.live:
                yield rows, queries
                continue
            of = items["cluster"][rows]
            together = []  # clusters that most queries want are scored for all of them, which is less work than many small products
            for c in np.unique(of).tolist():
                wanting = queries[self.live.get(c, self.anywhere)[queries]]
                if 2 * len(wanting) >= len(queries):
                    together.append(c)
                elif len(wanting):
                    yield rows[of == c], wanting
            if together:
                yield rows[np.isin(of, together)], queries

    def _scored(self, items, rows: np.ndarray, queries: np.ndarray) -> "_Rows":
        """The rows that may be among the best of some of the queries."""
        self.cells += len(rows) * len(queries)
        if self.orders or not (items["longest"] <= SINGLE_LENGTH and self.longest <= SINGLE_LENGTH):
            return self._scored_exactly(items, rows, queries)
        return self._scored_singly(items, rows, queries)

    def _scored_singly(self, items, rows: np.ndarray, queries: np.ndarray) -> "_Rows":
        """As ``_scored_exactly``; only pairs that reach the floor in single precision, less what that can be off by, are scored in full."""
        singles = items["singles"] if len(rows) == len(items["singles"]) else items["singles"][rows]
        asked = self.singles if len(queries) == self.count else self.singles[queries]
        near = singles @ asked.T
        off = self.off[queries] * items["longest"] + 10.0**-SCORE_DIGITS

        def passing():
            least = np.nextafter((self.floor[queries] - off).astype("float32"), np.float32(-np.inf))
            return np.flatnonzero(near >= least)

        good = passing()
        if self.most < len(rows) and len(good) > 4 * self.most * len(queries):
            shown = near.copy()
            barred = items["item_id"][rows][:, None] == self.barred[queries] if self.excluded else None
            if barred is not None:
                shown[barred & self.has_barred[queries]] = -np.inf
            reached = np.partition(shown, len(rows) - self.most, axis=0)[len(rows) - self.most]
            self.floor[queries] = np.maximum(self.floor[queries], reached - off)
            good = passing()
        if 16 * len(good) > near.size:
            return self._scored_exactly(items, rows, queries)
        row, at = np.divmod(good, len(queries))
        row, query = rows[row], queries[at]
        similarity = np.empty(len(row))
        part = max(1, BLOCK_CELLS // self.vectors.shape[1])
        for k in range(0, len(row), part):
            i, q = row[k : k + part], query[k : k + part]
            similarity[k : k + part] = np.einsum("ij,ij->i", items["vectors"][i], self.vectors[q])
        similarity = np.round(similarity, SCORE_DIGITS)
        keep = similarity >= self.floor[query]
        if self.excluded:
            keep &= ~(self.has_barred[query] & (items["item_id"][row] == self.barred[query]))
        row, query, similarity = row[keep], query[keep], similarity[keep]
        return _Rows(query, items["item_id"][row], similarity, similarity, items["price"][row], items["points"][row])

    def _scored_exactly(self, items, rows: np.ndarray, queries: np.ndarray) -> "_Rows":
        everything = len(rows) == len(items["vectors"])
        vectors = items["vectors"] if everything else items["vectors"][rows]
        asked = self.vectors if len(queries) == self.count else self.vectors[queries]
        similarity = np.round(vectors @ asked.T, SCORE_DIGITS)
        ids, price, points = items["item_id"][rows], items["price"][rows], items["points"][rows]
        key, barred = similarity, []
        if self.orders or self.excluded:
            for at, q in enumerate(queries.tolist()):
                if q in self.orders:
                    name, ascending = self.orders[q]
                    value = price if name == "price" else points
                    key = similarity.copy() if key is similarity else key
                    key[:, at] = np.where(np.isnan(value), -np.inf, -value if ascending else value)
                if q in self.excluded:
                    barred += [(row, at) for row in np.flatnonzero(ids == self.excluded[q]).tolist()]

        def passing():
            good = key >= self.floor[queries]
            for row, at in barred:
                good[row, at] = False
            return good

        good = passing()
        n = len(rows)
        if self.most < n and np.count_nonzero(good) > 4 * self.most * len(queries):
            shown = key.copy()
            for row, at in barred:
                shown[row, at] = -np.inf
            reached = np.partition(shown, n - self.most, axis=0)[n - self.most]
            self.floor[queries] = np.maximum(self.floor[queries], reached)
            good = passing()
        row, at = np.nonzero(good)
        return _Rows(queries[at], ids[row], similarity[row, at], key[row, at], price[row], points[row])

    def result(self, schema: pa.Schema, passed) -> pa.RecordBatch:
        kept = self.kept
        of_query = pa.array(kept.query, type=pa.int64())
        columns = {
            "query_id": self.queries.field("query_id").take(of_query),
            "item_id": pa.array(kept.item),
            "similarity": pa.array(kept.similarity),
            "sort_key": pa.array(kept.key),
            "price": pa.array(kept.price, from_pandas=True),
            "points": pa.array(kept.points, from_pandas=True),
            **{name: self.queries.field(name).take(of_query) for name in passed},
        }
        return pa.RecordBatch.from_arrays(
            [columns[f.name].cast(f.type) for f in schema], names=schema.names
        )


class _Rows:
    """Columns of kept rows: query number, item, similarity, rank key, price, points."""

    NAMES = ("query", "item", "similarity", "key", "price", "points")

    def __init__(self, *columns):
        self.query, self.item, self.similarity, self.key, self.price, self.points = columns

    @classmethod
    def empty(cls):
        kinds = ("int64", "int64", "float64", "float64", "float64", "float64")
        return cls(*[np.empty(0, dtype=k) for k in kinds])

    def plus(self, *others: "_Rows") -> "_Rows":
        return _Rows(*[np.concatenate([getattr(r, n) for r in (self, *others)]) for n in self.NAMES])

    def best(self, limit: np.ndarray) -> "_Rows":
        order = np.lexsort((self.item, -self.similarity, -self.key, self.query))
        query = self.query[order]
        starts = np.searchsorted(query, np.arange(len(limit)))
        keep = order[np.arange(len(query)) - starts[query] < limit[query]]
        return _Rows(*[getattr(self, n)[keep] for n in self.NAMES])

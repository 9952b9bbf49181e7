"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are projected several times to a few dimensions, shifted, and put in
the order of a Hilbert curve. Every curve is cut into ranges of a few thousand
vectors, which Spark deals to its tasks. A query goes to its own range on each
curve, there its best partners are found by exact inner products, and the lists
of all curves are merged and ranked again. Then it goes outwards, in turns that
double the distance: to the ranges beside its own, to the two behind them, and so
on. It takes along the score that its best ``k`` so far require, and a range
answers only with what reaches it, so a query gets about ``k`` rows a turn however
many vectors it meets.

How many neighbouring ranges are asked is measured: for a bounded sample of
queries the true neighbours are found among all vectors, and the smallest window
that reaches the wanted recall on them is taken. On vectors without structure
that window is a large part of the curve; on clustered ones a few ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealerflow.llm.common import saved

#: Curves, dimensions and bits of a projection, vectors of a range.
CURVES, DIMS, BITS, RANGE = 4, 6, 10, 4096
#: Parts of a range hold about this many times its vectors, and this many times as many queries, at most.
PART, TURN = 2, 4
#: Vectors the projections and ranges are fitted on, queries the window is fitted on, recall to reach there.
FIT_VECTORS, FIT_QUERIES, FIT_RECALL = 8192, 64, 0.96


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer cells (``bits`` bits a dimension)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations and reflections of the finer levels
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[-1] & bit) > 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Projections, shifts, scales and range bounds; ``top`` is the largest norm."""

    top: float
    axes: np.ndarray  # curve, dims, vector + 1
    low: np.ndarray  # curve, dims
    scale: np.ndarray
    bounds: tuple[np.ndarray, ...]

    def cells(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Cells on every curve. A norm below the largest becomes one more component, so that
        the largest inner product is the smallest distance."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = vectors / (norms if query else self.top)
        more = np.zeros_like(norms) if query else np.sqrt(np.maximum(0, 1 - (norms / self.top) ** 2))
        points = np.einsum("cdk,nk->cnd", self.axes, np.hstack([unit, more]))
        cells = (points - self.low[:, None, :]) * self.scale[:, None, :]
        return np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64)

    def ranges(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Range number of each vector on each curve."""
        keys = [hilbert_keys(c, BITS) for c in self.cells(vectors, query)]
        return np.stack([np.searchsorted(b, k, "right") for b, k in zip(self.bounds, keys, strict=True)])


def fit_curves(sample: np.ndarray, top: float, ranges: int) -> Curves:
    """Random orthogonal projections with random shifts; bounds that cut the sample into equal ranges."""
    rng = np.random.default_rng(11)
    size = sample.shape[1] + 1
    dims = min(DIMS, size)
    axes = np.stack([np.linalg.qr(rng.normal(size=(size, dims)))[0].T for _ in range(CURVES)])
    plain = Curves(top, axes, np.zeros((CURVES, dims)), np.ones((CURVES, dims)), ())
    norms = np.linalg.norm(sample, axis=1, keepdims=True)
    more = np.sqrt(np.maximum(0, 1 - (norms / top) ** 2))
    points = np.einsum("cdk,nk->cnd", axes, np.hstack([sample / top, more]))
    low, high = points.min(axis=1), points.max(axis=1)
    width = np.maximum(high - low, 1e-9)
    low = low - rng.uniform(0.05, 0.3, low.shape) * width
    scale = ((1 << BITS) - 1) / (1.4 * width)
    placed = Curves(plain.top, axes, low, scale, ())
    bounds = []
    for cells in placed.cells(sample, query=False):
        keys = np.sort(hilbert_keys(cells, BITS))
        bounds.append(keys[[len(keys) * i // ranges for i in range(1, ranges)]] if ranges > 1 else keys[:0])
    return Curves(top, axes, low, scale, tuple(bounds))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part; see ``nearest``."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & good & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").take(1)
    return rows.where(F.size("vector") == (sizes[0].dims if sizes else 0))


def _best(scores: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best scores of each row; a row with a bound has none below it."""
    cut = np.full(len(scores), -np.inf)
    if scores.shape[1] > k:
        # Ties at the cut are kept, so that the smaller id can win them.
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    if bounds is not None:  # a matrix product's scores are off by roundings
        cut = np.maximum(cut, bounds - 1e-9 * np.maximum(1, np.abs(bounds)))
    return np.nonzero(scores >= cut[:, None])


def _top(rows: DataFrame, by: str, node: str, k: int, rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), node)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def nearest(
    vectors: DataFrame,
    is_query: str,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = FIT_RECALL,
    range_size: int = RANGE,
) -> DataFrame:
    """``query_id``, ``rank``, the neighbour's id and ``score`` for every row for which ``is_query`` holds.

    ``is_query`` is SQL over ``id``. A query's own row is no neighbour; ties go to
    the smaller id. Vectors that are null, zero, hold a null, NaN or infinite
    component or differ in length from most others take no part, neither as
    query nor as neighbour; rows without id neither. Equal vectors are one node
    with their ``k + 1`` smallest ids, which is all a list of ``k`` can show, so
    copies cost nothing. Repeated rows count once. No usable vector: no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType
    # The k + 1 smallest ids of each vector; the rank filter prunes groups before the shuffle.
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    nodes = saved(few.groupBy("vector").agg(F.min("id").alias("node"), F.sort_array(F.collect_set("id")).alias("ids")))
    asked = rows.where(is_query).distinct().join(nodes.select("vector", "node"), "vector")
    asked = saved(asked.select("id", "node"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("vector")).alias("dims")).first()
    out = f"query_id {kind.simpleString()}, rank int, `{id_col}` {kind.simpleString()}, score double"
    if not facts.n:
        return vectors.sparkSession.createDataFrame([], out)

    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(FIT_VECTORS).select("vector").toPandas()["vector"]
    curves = fit_curves(np.array(sample.tolist(), float), float(facts.top), math.ceil(facts.n / range_size))
    reps = saved(asked.select("node").distinct().join(nodes.select("node", "vector"), "node"))
    window = fit_window(nodes, reps, curves, k, recall)
    best = saved(_top(meet(nodes, reps, curves, 0, 0, k + 1, range_size).distinct(), "query", "node", k + 1).drop("rank"))
    inner = 1
    while inner <= window:
        outer = min(2 * inner - 1, window)
        full = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound"))
        bounds = full.where(F.col("n") > k).select(F.col("query").alias("node"), "bound")
        more = meet(nodes, reps.join(bounds, "node", "left"), curves, inner, outer, k + 1, range_size)
        best = saved(_top(best.unionByName(more).distinct(), "query", "node", k + 1).drop("rank"))
        inner = outer + 1

    # From nodes to ids: the k + 1 best ids of every asked vector, then without the asker's own.
    ids = best.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("near"))
    ids = _top(ids, "query", "near", k + 1).drop("rank")
    each = asked.join(ids, asked["node"] == ids["query"]).where("id <> near").select("id", "near", "score")
    each = _top(each, "id", "near", k)
    return each.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("near").alias(id_col), "score")


def fit_window(nodes: DataFrame, reps: DataFrame, curves: Curves, k: int, recall: float) -> int:
    """Ranges to each side that hold ``recall`` of the true neighbours of a bounded sample of queries."""
    ranges = len(curves.bounds[0]) + 1
    sample = reps.orderBy(F.xxhash64("node"), "node").limit(FIT_QUERIES).toPandas() if ranges > 1 else None
    if sample is None or not len(sample):
        return 0
    names, queries = sample["node"].tolist(), np.array(sample["vector"].tolist(), float)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = queries @ _matrix(batch.column(1)).T
            q, n = _best(scores, k + 1)
            arrays = [pa.array(names, batch.column(0).type).take(pa.array(q)), batch.column(0).take(pa.array(n)), pa.array(scores[q, n])]
            yield pa.RecordBatch.from_arrays(arrays, ["query", "node", "score"])

    kind = nodes.schema["node"].dataType.simpleString()
    true = nodes.select("node", "vector").mapInArrow(exact, f"query {kind}, node {kind}, score double")
    true = _top(true, "query", "node", k + 1).join(nodes.select("node", "vector"), "node").where("query <> node").toPandas()
    if not len(true):
        return 0
    at = dict(zip(names, curves.ranges(queries, query=True).T, strict=True))
    near = curves.ranges(np.array(true["vector"].tolist(), float)).T
    gaps = np.sort([np.abs(at[q] - n).min() for q, n in zip(true["query"], near, strict=True)])
    return int(gaps[min(len(gaps) - 1, math.ceil(recall * len(gaps)) - 1)])


def deal(
    nodes: DataFrame, reps: DataFrame, curves: Curves, window: int, size: int, inner: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The vectors and the queries with the places where they meet: curve, range, part of its vectors, turn of its queries.

    A query goes to the ranges ``inner`` to ``window`` away on either side. A
    vector is in one part of its range and comes to all turns; a query has one
    turn in a range and goes to all parts. So every pair meets once a curve, and
    no place holds more than a bounded number of either.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    most = len(curves.bounds[0])
    if "bound" not in reps.columns:
        reps = reps.withColumn("bound", F.lit(None).cast("double"))
    steps = sorted({s for d in range(inner, window + 1) for s in (-d, d)})

    def place(asking: bool, steps: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first in range(0, whole.num_rows, 2048):
                    batch = whole.slice(first, 2048)
                    own = curves.ranges(_matrix(batch.column(1)), asking)
                    for c, spots in enumerate(own):
                        for step in steps:
                            hit = spots + step
                            inside = pa.array(np.flatnonzero((hit >= 0) & (hit <= most)))
                            columns = [batch.column(i).take(inside) for i in range(batch.num_columns)]
                            places = [np.full(len(inside), c), hit[inside.to_numpy()]]
                            yield pa.RecordBatch.from_arrays(
                                [*columns, *(pa.array(p, pa.int32()) for p in places)], [*batch.schema.names, "curve", "range"]
                            )

        return run

    schema = f"node {kind}, vector array<double>"
    data = nodes.select("node", "vector").mapInArrow(place(False, [0]), f"{schema}, curve int, range int")
    asked = reps.select("node", "vector", "bound").mapInArrow(place(True, steps), f"{schema}, bound double, curve int, range int")
    one = F.lit(1).cast("bigint")
    wide = None
    if most:  # a single range holds no more than its size
        many = data.groupBy("curve", "range").agg(F.ceil(F.count(F.lit(1)) / (PART * size)).alias("parts"))
        own = reps.select("node", "vector").mapInArrow(place(True, [0]), f"{schema}, curve int, range int").groupBy("curve", "range").count()
        near = own.select("curve", F.explode(F.array(*[F.col("range") + s for s in steps])).alias("range"), "count")
        near = near.groupBy("curve", "range").agg(F.ceil(F.sum("count") / (TURN * size)).alias("turns"))
        both = many.withColumn("turns", one).unionByName(near.withColumn("parts", one))
        both = both.groupBy("curve", "range").agg(F.max("parts").alias("parts"), F.max("turns").alias("turns"))
        wide = saved(both.where("parts > 1 or turns > 1"))
    if wide is None or wide.isEmpty():
        return tuple(t.withColumns({"part": F.lit(0).cast("bigint"), "turn": F.lit(0).cast("bigint")}) for t in (data, asked))

    def spread(rows: DataFrame, by: str, over: str) -> DataFrame:
        """One of ``by`` by the node's hash, each of ``over``."""
        columns = rows.columns
        rows = rows.join(wide, ["curve", "range"], "left").withColumns({c: F.coalesce(c, one) for c in ("parts", "turns")})
        rows = rows.withColumn(by, F.pmod(F.xxhash64("node"), f"{by}s"))
        rows = rows.withColumn(over, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{over}s") - 1)))
        return rows.select(*columns, "part", "turn")

    return spread(data, "part", "turn"), spread(asked, "turn", "part")


def meet(nodes: DataFrame, reps: DataFrame, curves: Curves, inner: int, outer: int, k: int, size: int = RANGE) -> DataFrame:
    """query, node, score: of every part of a range that a query asks its ``k`` best, no score below the query's ``bound``.

    The query's own node is not left out.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    data, asked = deal(nodes, reps, curves, outer, size, inner)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": left["node"].iloc[:0], "node": right["node"].iloc[:0], "score": np.zeros(0)})]
        if len(left) and len(right):
            matrix, names = np.stack(right["vector"].to_numpy()), right["node"].to_numpy()
            for first in range(0, len(left), 256):
                some = left.iloc[first : first + 256]
                rows = np.stack(some["vector"].to_numpy())
                q, n = _best(rows @ matrix.T, k, some["bound"].fillna(-np.inf).to_numpy())
                # One product a pair, not a matrix product: equal pairs get equal scores on every curve.
                exact = np.concatenate([np.zeros(0), *((rows[q[i : i + 4096]] * matrix[n[i : i + 4096]]).sum(axis=1) for i in range(0, len(q), 4096))])
                found.append(pd.DataFrame({"query": some["node"].to_numpy()[q], "node": names[n], "score": exact}))
        return pd.concat(found)

    keys = ["curve", "range", "part", "turn"]
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(score, f"query {kind}, node {kind}, score double")

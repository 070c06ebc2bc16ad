"""An inverted-file index: vectors by nearest centroid, searched in the nearest cells.

Centroids are fitted on a bounded sample; every row is indexed. Cells are
partitions of the index table, so a search reads only the cells that it probes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.errors import InvalidArgument
from vecmill.operators.metrics import Metric, metric
from vecmill.operators.search import QUERY_BYTES, knn_join, top_n


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Lloyd's iterations from points drawn at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(d, 1)[:, :k]


@dataclass
class IvfIndex:
    """``path``: the rows by ``cell``. Cosine indexes directions, so vectors are normalised first. ``probes``: how many cells a search reads by default."""

    path: str
    centres: np.ndarray
    metric: Metric
    schema: T.StructType
    probes: int = 8

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def _ready(self, x: np.ndarray) -> np.ndarray:
        if self.metric.name == "cosine":
            n = np.linalg.norm(x, axis=-1, keepdims=True)
            return x / np.where(n == 0, 1, n)
        return x

    def cells_of(self, query: Sequence[float], probes: int) -> list[int]:
        return _nearest(self._ready(np.asarray(query, np.float64)[None, :]), self.centres, probes)[0].tolist()

    def search(self, spark, query: Sequence[float], n: int, probes: int | None = None, where: Column | None = None,
        exact_below: int = 4096) -> DataFrame:
        """The n closest rows of the probed cells that pass the filter.

        Where a filter leaves at most ``exact_below`` rows, all of those are
        compared; where the probed cells hold fewer than n passing rows, all
        cells are.
        """
        rows = self.rows(spark)
        passing = rows if where is None else rows.where(where)
        if where is not None and passing.limit(exact_below + 1).count() <= exact_below:
            return top_n(passing, query, n, self.metric).drop("cell")
        cells = self.cells_of(query, probes or self.probes)
        probed = passing.where(F.col("cell").isin(cells))
        if probed.limit(n).count() < n:
            probed = passing
        return top_n(probed, query, n, self.metric).drop("cell")

    def search_many(self, spark, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id",
        query_key: str = "query") -> DataFrame:
        """(query_id, key_id, similarity, rank): for each query the k closest rows of the cells it probes, in one scan.

        Queries travel to every task; more than ``QUERY_BYTES`` of them are refused, to be given in parts.
        """
        asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_key).cast("array<double>").alias("x")).collect()
        if sum(len(r["x"]) for r in asked) * 8 > QUERY_BYTES:
            raise InvalidArgument("too many queries for one search")
        ids, x = np.array([r["q"] for r in asked], np.int64), np.array([r["x"] for r in asked], np.float64)
        cells = _nearest(self._ready(x), self.centres, probes or self.probes) if len(x) else np.zeros((0, 1), int)
        given, m = spark.sparkContext.broadcast((ids, x, cells)), self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, cells = given.value
            for b in batches:
                cell, keys = b.column("cell").to_numpy(), b.column("key_id").to_numpy()
                for c in np.unique(cell):
                    mine, at = np.flatnonzero((cells == c).any(1)), np.flatnonzero(cell == c)
                    if not len(mine):
                        continue
                    v = b.column("key").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                    s = m.matrix(x[mine], v)
                    far = np.where(np.isnan(s), np.inf, -s if m.greater_is_closer else s)
                    top = np.argsort(far, 1, kind="stable")[:, :k]
                    rows = np.repeat(np.arange(len(mine)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine][rows]), pa.array(keys[at][top.reshape(-1)]),
                        pa.array(s[rows, top.reshape(-1)])], ["q", "r", "similarity"])

        found = self.rows(spark).where(F.col("cell").isin(sorted(set(cells.reshape(-1).tolist())))).select("cell", "key_id",
            "key").mapInArrow(run, "q long, r long, similarity double")
        w = Window.partitionBy("q").orderBy(m.order("similarity"), F.desc("r"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id),
            F.col("r").alias("key_id"), "similarity", "rank")


def build(rows: DataFrame, path: str, by: str | Metric = "euclidean", cells: int | None = None, sample: int = 20_000, key: str = "key",
    recall: float = 0.95, tried: int = 200, k: int = 10) -> IvfIndex:
    """Index every row; centroids come from at most ``sample`` rows, the first by a hash of key_id.

    ``probes`` is measured: ``tried`` of those rows are searched exactly, and so
    many cells are read by default as hold the share ``recall`` of their ``k`` closest others.
    """
    m = metric(by)
    count = rows.count()
    # a share of about twice the sample is cut out first, so that what meets in one task is bounded
    h = F.pmod(F.xxhash64("key_id", F.lit("sample")), F.lit(1 << 31))
    some = rows.where(h <= int(min(1.0, (2 * sample + 100) / max(1, count)) * (1 << 31)))
    drawn = some.orderBy(h, "key_id").limit(sample).select(F.col(key).alias("x"), "key_id").collect()
    x = np.array([r["x"] for r in drawn], np.float64)
    index = IvfIndex(path, np.zeros((1, x.shape[1] if x.ndim == 2 else 1)), m,
        T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    if len(x):
        index.centres = fit_centroids(index._ready(x), cells or max(1, min(4096, int(count**0.5))))
    given = rows.sparkSession.sparkContext.broadcast(index)  # at most 4096 centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(key)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            cell = _nearest(given.value._ready(x), given.value.centres, 1)[:, 0] if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # cells are spread over several tasks each, so that a crowded one is no single task
    rows.mapInArrow(run, f"{kinds}, cell int").repartition(F.col("cell"),
        F.pmod(F.xxhash64("key_id"), F.lit(4))).write.partitionBy("cell").parquet(path)
    if len(x):
        index.probes = _measured(rows.sparkSession, index, [(r["key_id"], r["x"]) for r in drawn[:tried]], k, recall, key)
    return index


def _measured(spark, index: IvfIndex, queries: list, k: int, recall: float, key: str) -> int:
    """The fewest cells in which the share ``recall`` of the queries' true neighbours lies."""
    asked = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in queries], "query_id long, query array<double>")
    held = index.rows(spark)
    truth = knn_join(asked, held.select("key_id", key), k, index.metric, row_key=key)
    cells = truth.join(held.select("key_id", "cell"), "key_id").select("query_id", "cell").collect()  # k rows a query
    order = np.argsort(_nearest(index._ready(np.array([x for _, x in queries], np.float64)), index.centres, len(index.centres)), 1)
    at = {i: n for n, (i, _) in enumerate(queries)}
    ranks = sorted(int(order[at[r["query_id"]], r["cell"]]) for r in cells)
    return ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1

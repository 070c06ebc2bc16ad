"""Top-n search and batch nearest-neighbour joins, exact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill import storage
from vecmill.errors import InvalidArgument
from vecmill.operators.metrics import Metric, closest, metric, vector

QUERY_BYTES = 32 << 20  # most bytes of query vectors that travel to every task
PART_ROWS, PART_QUERIES = 2048, 1024  # scores of so many rows and queries are held at once


def top_n(rows: DataFrame, query: Sequence[float], n: int, by: str | Metric = "cosine", where: Column | None = None, key: str = "key",
    tie: str = "key_id") -> DataFrame:
    """The n closest rows, closest first, with ``similarity``; ties by descending ``tie``.

    The filter stands before the score, so only passing rows are scored, and
    the limit stands above the order, so each task keeps n rows.
    """
    if n <= 0:
        raise InvalidArgument("closest_n must be above 0")
    m = metric(by)
    passing = rows if where is None else rows.where(where)
    return passing.withColumn("similarity", m.score(F.col(key), vector(query))).orderBy(m.order("similarity"), F.desc(tie)).limit(n)


def knn_join(
    queries: DataFrame, rows: DataFrame, k: int, by: str | Metric = "cosine", query_id: str = "query_id", query_key: str = "query",
        row_id: str = "key_id", row_key: str = "key", keep_self: bool = False
) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k closest rows of each query; ties by descending row id.

    Queries of up to 32 MB travel to every task and rows are scanned once, by
    matrix products. More queries are dealt into blocks and rows into chunks of
    about that size, which meet in units of work, so nothing passes through the
    driver. By distances and cosines chunks are cells around pivots, and a query
    meets its own cell, then those alone that may hold a row as near as its k-th
    there (``_cells``); by other metrics every block meets every chunk. Every task or unit
    keeps k rows a query and one grouped limit merges them. No pair below its own k best leaves it.
    Vectors whose dimension differs from the query's are not compared.
    """
    if k <= 0:
        raise InvalidArgument("k must be above 0")
    m = metric(by)
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_key).cast("array<double>").alias("x"))
    held = rows.select(F.col(row_id).cast("long").alias("r"), F.col(row_key).alias("y"))
    size, longest = asked.agg(F.sum(8 * F.size("x") + 16), F.max(F.size("x"))).first()
    size = size or 0
    if size <= QUERY_BYTES:
        found = _scan(asked.where("x is not null").collect(), held, k, m, keep_self)
    elif m.name in CELLED:
        found = _cells(asked.where("x is not null"), held.where("y is not null"), longest, k, m, keep_self,
            "float" if {t.elementType.simpleString() for t in (queries.schema[query_key].dataType, rows.schema[row_key].dataType)} == {"float"} else "double")
    else:
        found = _grid(asked, held, size, k, m, keep_self)
    w = Window.partitionBy("q").orderBy(m.order("similarity"), F.desc("r"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id),
        F.col("r").alias(row_id), "similarity", "rank")


class Closest:
    """The k closest rows of each query among those shown so far."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, m: Metric, keep_self: bool):
        """``queries``: (ids, vectors) by dimension."""
        self.queries, self.k, self.m, self.keep_self = queries, k, m, keep_self
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.least = {d: np.full(len(q), -np.inf) for d, (q, _) in queries.items()}

    def _settle(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k closest of each query, ties by descending id; what is farther is of no more use."""
        q, i, c = (np.concatenate(x) for x in zip(*self.held[d], strict=True))
        order = np.lexsort((-i, -c, q))
        q, i, c = q[order], i[order], c[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, i, c, nth = q[nth < self.k], i[nth < self.k], c[nth < self.k], nth[nth < self.k]
        last = np.flatnonzero(nth == self.k - 1)
        self.least[d][q[last]] = c[last]
        self.held[d] = [(q, i, c)]
        return q, i, c

    def show(self, ids: np.ndarray, vectors: pa.ListArray) -> None:
        lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
        for d, (q, x) in self.queries.items():
            at = np.flatnonzero((lengths == d) & np.asarray(vectors.is_valid()))
            for part in np.array_split(at, -(-len(at) // PART_ROWS)) if len(at) else ():
                v = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), d)
                for s in range(0, len(q), PART_QUERIES):
                    own = slice(s, s + PART_QUERIES)
                    same = None if self.keep_self else q[own, None] == ids[part][None, :]
                    qs, rs, score = closest(self.m, x[own], v, self.k, self.least[d][own], same)
                    self.held.setdefault(d, []).append((qs + s, ids[part][rs], score if self.m.greater_is_closer else -score))
                self._settle(d)

    def _meet(self, d: int, at: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        q, x = self.queries[d]
        same = None if self.keep_self else q[at, None] == ids[None, :]
        qs, rs, score = closest(self.m, x[at], v, self.k, self.least[d][at], same)
        self.held.setdefault(d, []).append((at[qs], ids[rs], score if self.m.greater_is_closer else -score))

    def show_leaves(self, ids: np.ndarray, v: np.ndarray, asked: np.ndarray) -> None:
        """The rows, all of one dimension and ``ordinary``, to the queries ``asked`` of that dimension, these ordinary too.

        Rows are parted into small leaves. A query first meets the leaves nearest to it, until it has k rows, and then
        those alone whose nearest possible row is not beyond its k-th.
        """
        d = v.shape[1]
        near, points = nearness(self.m, v), nearness(self.m, self.queries[d][1][asked])
        leaf = leaves(near)
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        members = np.split(order, cuts)
        centres = np.stack([near[i].mean(0) for i in members])
        radii = np.array([np.sqrt(((near[i] - c) ** 2).sum(1).max()) for i, c in zip(members, centres, strict=True)])
        for at in range(0, len(asked), PART_ROWS):
            own = asked[at : at + PART_ROWS]
            far = distances(points[at : at + PART_ROWS], centres)
            met = np.zeros(far.shape, bool)
            closest_leaves = np.argsort(far, 1)[:, :FIRST_LEAVES]
            for nth in range(closest_leaves.shape[1]):
                open_ = np.flatnonzero(np.isinf(self.least[d][own]))
                if not len(open_):
                    break
                met[open_, closest_leaves[open_, nth]] = True
                for n in np.unique(closest_leaves[open_, nth]):
                    self._meet(d, own[open_[closest_leaves[open_, nth] == n]], ids[members[n]], v[members[n]])
                self._settle(d)
            due = far - radii <= reach(self.m, self.least[d][own])[:, None] + allowance(points[at : at + PART_ROWS], centres)
            for n in np.flatnonzero((due & ~met).any(0)):
                self._meet(d, own[np.flatnonzero(due[:, n] & ~met[:, n])], ids[members[n]], v[members[n]])
            if d in self.held:
                self._settle(d)

    def found(self) -> Iterator[pa.RecordBatch]:
        for d in self.held:
            q, i, c = self._settle(d)
            s = c if self.m.greater_is_closer else -c
            yield pa.RecordBatch.from_arrays([pa.array(self.queries[d][0][q]), pa.array(i), pa.array(s, mask=np.isinf(s))],
                ["q", "r", "similarity"])


def _by_dimension(ids: Sequence[int], vectors: Sequence[Sequence[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by: dict[int, list] = {}
    for q, x in zip(ids, vectors, strict=True):
        by.setdefault(len(x), []).append((q, x))
    return {d: (np.array([q for q, _ in v]), np.array([x for _, x in v], np.float64)) for d, v in by.items()}


FOUND = "q long, r long, similarity double"


def _scan(queries: list, rows: DataFrame, k: int, m: Metric, keep_self: bool) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(_by_dimension([r["q"] for r in queries], [r["x"] for r in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Closest(given.value, k, m, keep_self)
        for b in batches:
            best.show(b.column("r").to_numpy(), b.column("y"))
        yield from best.found()

    return rows.mapInArrow(run, FOUND)


def _grid(queries: DataFrame, rows: DataFrame, size: int, k: int, m: Metric, keep_self: bool) -> DataFrame:
    """Blocks of queries by chunks of rows. A row travels once for each block, a query once for each chunk."""
    blocks = -(-size // QUERY_BYTES)
    chunks = max(1, -(-(rows.agg(F.sum(8 * F.size("y") + 16)).first()[0] or 0) // QUERY_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.where("x is not null").select(place("q", blocks).alias("block"), every(chunks).alias("chunk"),
        F.lit(0).alias("side"), F.col("q").alias("id"), F.col("x").alias("v"))
    held = rows.where("y is not null").select(every(blocks).alias("block"), place("r", chunks).alias("chunk"), F.lit(1).alias("side"),
        F.col("r").alias("id"), F.col("y").cast("array<double>").alias("v"))
    dealt = asked.unionAll(held).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, vectors, best = None, [], [], None
        for b in batches:
            block, chunk, side = (b.column(n).to_numpy() for n in ("block", "chunk", "side"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if at == end:
                    continue
                if unit != (block[at], chunk[at]):
                    if best is not None:
                        yield from best.found()
                    unit, ids, vectors, best = (block[at], chunk[at]), [], [], None
                part = b.slice(at, end - at)
                if side[at] == 0:
                    ids += part.column("id").to_pylist()
                    vectors += part.column("v").to_pylist()
                elif ids:
                    best = best or Closest(_by_dimension(ids, vectors), k, m, keep_self)
                    own = part.column("v")
                    best.show(part.column("id").to_numpy(),
                        pa.ListArray.from_arrays(pa.array(own.offsets.to_numpy() - own.offsets[0].as_py()), own.flatten()))
        if best is not None:
            yield from best.found()

    return dealt.mapInArrow(run, FOUND)


CELLED = ("cosine", "euclidean", "squared_euclidean")
LEAF_ROWS, FIRST_LEAVES = 64, 4


def nearness(m: Metric, v: np.ndarray) -> np.ndarray:
    """Vectors whose Euclidean distances order rows as the metric does."""
    return v / np.linalg.norm(v, axis=1)[:, None] if m.name == "cosine" else v


def reach(m: Metric, least: np.ndarray) -> np.ndarray:
    """The Euclidean distance of ``nearness`` beyond which the closeness is below ``least``."""
    if m.name == "cosine":
        return np.where(np.isinf(least), np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isinf(least), 0, least))))
    return np.where(np.isinf(least), np.inf, np.sqrt(-least) if m.name == "squared_euclidean" else -least)


def ordinary(m: Metric, v: np.ndarray) -> np.ndarray:
    """Which vectors have distances that bounds hold for: finite, not too large to square, and not zero by cosine."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.einsum("ij,ij->i", v, v)
    return np.isfinite(size) & (size < 1e200) & ((size > 1e-200) | (m.name != "cosine"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By a matrix product: close ones are inexact by some 1e-8 of the vectors' lengths."""
    out = -2 * (a @ b.T)
    out += np.einsum("ij,ij->i", a, a)[:, None]
    out += np.einsum("ij,ij->i", b, b)[None, :]
    return np.sqrt(np.maximum(out, 0, out=out), out=out)


def allowance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than ``distances`` can err by, for each row of ``a``."""
    return 1e-6 * (np.linalg.norm(a, axis=1)[:, None] + np.linalg.norm(b, axis=1).max(initial=0))


def leaves(v: np.ndarray) -> np.ndarray:
    """A number of a leaf for each row; leaves hold rows near to one another, some ``LEAF_ROWS`` each."""
    centres = v[:: LEAF_ROWS]
    for turn in range(3):
        leaf = np.concatenate([distances(v[s : s + PART_ROWS], centres).argmin(1) for s in range(0, len(v), PART_ROWS)])
        if turn == 2:
            return leaf
        used, leaf, n = np.unique(leaf, return_inverse=True, return_counts=True)
        order = np.argsort(leaf, kind="stable")
        centres = np.add.reduceat(v[order], np.r_[0, np.cumsum(n)[:-1]]) / n[:, None]


def _matrices(ids: np.ndarray, column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, vectors) by dimension of a column of lists, without those that hold nulls or nothing."""
    lengths = np.diff(column.offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)


def _cells(queries: DataFrame, rows: DataFrame, dim: int, k: int, m: Metric, keep_self: bool, number: str) -> DataFrame:
    """Each row in the cell of its nearest pivot, a sampled row; a cell's radius bounds how near its rows can be.

    A query's k best of its own cell bound what it still needs, so it then visits the cells within that reach alone. Where
    bounds exclude nothing every query visits every cell, which is the whole grid. Rows that bounds do not
    hold for (of another dimension, not finite, zero by cosine) lie in cell -1, which all visit; such queries
    visit all. Cells of many rows are cut by hash, and so are the queries of a cell. Vectors travel as ``number``.
    """
    spark, bytes_of = rows.sparkSession, 8 * dim + 16
    total = rows.count()
    wanted = max(1, -(-total * bytes_of // QUERY_BYTES))
    hashed = rows.where(F.pmod(F.xxhash64("r", F.lit(1)), F.lit(max(1, total // (8 * wanted)))) == 0).where(F.size("y") == dim)
    sample = [r["y"] for r in hashed.orderBy(F.xxhash64("r", F.lit(2)), "r").limit(wanted).collect()]
    pivots = np.array([y for y in sample if None not in y], np.float64).reshape(-1, dim)
    pivots = nearness(m, pivots[ordinary(m, pivots)])

    def near(v: np.ndarray) -> np.ndarray:
        return ordinary(m, v) if v.shape[1] == dim and len(pivots) else np.zeros(len(v), bool)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.full(len(b), -1, np.int32), np.full(len(b), np.inf)
            for at, v in _matrices(b.column("r").to_numpy(), b.column("y")):
                good = near(v)
                for s in range(0, int(good.sum()), PART_ROWS):
                    own = np.flatnonzero(good)[s : s + PART_ROWS]
                    apart = distances(nearness(m, v[own]), pivots)
                    cell[at[own]], far[at[own]] = apart.argmin(1), apart.min(1)
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("y"), pa.array(cell), pa.array(far)], ["r", "y", "cell", "far"])

    kind = rows.schema["y"].dataType.simpleString()
    held = storage.persist(rows.mapInArrow(place, f"r long, y {kind}, cell int, far double"), "cells")
    facts = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    cells = np.array([r["cell"] for r in facts], np.int32)
    sizes, radii = {r["cell"]: r["n"] for r in facts}, np.array([r["far"] for r in facts])
    centres = np.stack([pivots[c] if c >= 0 else np.zeros(dim) for c in cells]) if len(cells) else np.zeros((0, dim))

    def routed(asked: DataFrame, first: bool) -> DataFrame:
        """The queries with each cell to visit: at first their own and -1, then what their reach leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                least = b.column("least").to_numpy()
                for part, v in _matrices(b.column("q").to_numpy(), b.column("x")):
                    for s in range(0, len(part), PART_ROWS):
                        at, x = part[s : s + PART_ROWS], v[s : s + PART_ROWS]
                        good = near(x)
                        visits = np.zeros((len(at), len(cells)), bool)
                        own = visits.copy()
                        visits[:, cells < 0], visits[~good] = True, True
                        if good.any() and (cells >= 0).any():
                            far = np.where(cells >= 0, distances(nearness(m, x[good]), centres), np.inf)
                            own[np.flatnonzero(good), far.argmin(1)] = True
                            if not first:
                                within = reach(m, least[at[good]])[:, None] + allowance(nearness(m, x[good]), centres)
                                visits[good] = (far - np.where(cells >= 0, radii, 0) <= within) & (cells >= 0)
                        visits = visits | own if first else visits & ~own & good[:, None]
                        q, c = np.nonzero(visits)
                        took = b.take(pa.array(at[q]))
                        yield pa.RecordBatch.from_arrays([took.column("q"), took.column("x"), took.column("least"), pa.array(cells[c], pa.int32())],
                            ["q", "x", "least", "cell"])

        return asked.mapInArrow(run, f"q long, x array<{number}>, least double, cell int")

    def met(asked: DataFrame, first: bool) -> DataFrame:
        visits = routed(asked, first)
        counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        cut = [(c, -(-sizes[c] * bytes_of // (2 * QUERY_BYTES)), -(-n * bytes_of // QUERY_BYTES)) for c, n in counts.items()]
        cuts = F.broadcast(spark.createDataFrame(cut, "cell int, slices int, blocks int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = visits.join(cuts, "cell").select("cell", dealt("q", "blocks").alias("block"), every("slices").alias("slice"),
            F.lit(0).alias("side"), F.col("q").alias("id"), F.col("x").alias("v"), "least")
        right = held.join(cuts, "cell").select("cell", every("blocks").alias("block"), dealt("r", "slices").alias("slice"),
            F.lit(1).alias("side"), F.col("r").alias("id"), F.col("y").cast(f"array<{number}>").alias("v"), F.lit(0.0).alias("least"))
        unit = ["cell", "block", "slice"]
        return left.unionAll(right).repartition(*unit).sortWithinPartitions(*unit, "side").mapInArrow(run_units, FOUND)

    def run_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []
        for b in batches:
            names = [b.column(n).to_numpy() for n in ("cell", "block", "slice")]
            cuts = (np.flatnonzero(np.any([np.diff(n) != 0 for n in names], axis=0)) + 1).tolist()
            for at, end in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if at == end:
                    continue
                if unit != (now := tuple(int(n[at]) for n in names)):
                    yield from one_unit(parts)
                    unit, parts = now, []
                parts.append(b.slice(at, end - at).select(["cell", "side", "id", "v", "least"]))
        yield from one_unit(parts)

    def one_unit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        parts.clear()
        side = t.column("side").to_numpy()
        split = int(np.searchsorted(side, 1))
        ids, v = t.column("id").to_numpy(), t.column("v").chunk(0)
        if split in (0, len(ids)):
            return
        whole = lambda a: pa.ListArray.from_arrays(pa.array(a.offsets.to_numpy() - a.offsets[0].as_py()), a.flatten())
        asked = {x.shape[1]: (at, x) for at, x in _matrices(ids[:split], whole(v.slice(0, split)))}
        best = Closest({d: (ids[:split][at], x) for d, (at, x) in asked.items()}, k, m, keep_self)
        for d, (at, _) in asked.items():
            best.least[d] = t.column("least").to_numpy()[at].copy()
        shown = whole(v.slice(split))
        if t.column("cell")[0].as_py() < 0:
            best.show(ids[split:], shown)
        else:
            good = near(asked[dim][1]) if dim in asked else np.zeros(0, bool)
            if good.any():
                best.show_leaves(ids[split:], next(x for _, x in _matrices(ids[split:], shown)), np.flatnonzero(good))
            others = {d: (best.queries[d][0][~ok], x[~ok]) for d, (_, x) in asked.items() if d == dim for ok in [good]}
            if others and len(others[dim][0]):
                odd = Closest(others, k, m, keep_self)
                odd.show(ids[split:], shown)
                yield from odd.found()
        yield from best.found()

    none = F.lit(float("-inf"))
    queries = queries.select("q", F.col("x").cast(f"array<{number}>").alias("x"))
    asked = queries.select("q", "x", none.alias("least"))
    first = storage.persist(met(asked, True), "nearest")
    closeness = F.col("similarity") if m.greater_is_closer else -F.col("similarity")
    kth = first.where("similarity is not null").groupBy("q").agg(F.sort_array(F.collect_list(closeness), False).alias("c"))
    least = kth.select("q", F.coalesce(F.try_element_at("c", F.lit(k)), none).alias("least"))
    later = met(queries.join(least, "q", "left").select("q", "x", F.coalesce("least", none).alias("least")), False)
    return first.unionAll(later)


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, query_id: str = "query_id", row_id: str = "key_id") -> DataFrame:
    """(query_id, recall): the share of each query's true neighbours that were found."""
    hits = truth.join(found.select(query_id, row_id).withColumn("hit", F.lit(1)), [query_id, row_id], "left")
    return hits.groupBy(query_id).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(k)).alias("recall"))

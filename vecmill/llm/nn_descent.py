"""Embedding near-duplicates by NN-descent (operator 4).

A neighbour graph starts from random hyperplane trees, whose leaves hold
vectors that lie on the same sides, and is refined by joining neighbours of
neighbours until little changes. Lists that stay full of links are enlarged;
where they outgrow the largest size, the vector lies in a dense group, and the
whole connected group is compared in blocks, which counts links without ever
listing them. A sample of vectors, compared with all, audits the recall; while
it is too low, more trees are added. All cosines are in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecmill.llm.blocks import block_pairs, by_unit, joining_edges
from vecmill.llm.common import connected_components, discard, first_by_hash, in_batches, materialize

LIST = "id long, other long, sim double"


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one dimension, as rows of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vector: str):
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def leaves(vectors: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """(tree, leaf, id): the leaf of each vector in each tree. Dimensions never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).normal(size=(int(d), trees * bits))
                x = unit_rows(b.column("v").take(pa.array(rows)))
                sides = (x @ planes[d] > 0).reshape(len(rows), trees, bits)
                leaf = (sides @ (1 << np.arange(bits, dtype=np.int64))) * 65536 + d
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(trees, dtype=np.int64), len(rows))), pa.array(leaf.reshape(-1)),
                        b.column("id").take(pa.array(np.repeat(rows, trees)))], ["g", "h", "id"]
                )

    return in_batches(vectors.select("id", "dim", "v"), run, "g long, h long, id long")


def _nearest(size: int, floor: float, full: tuple[float, int] | None = None):
    """Work on a unit: each member's ``size`` nearest others in it, from ``floor`` up.

    ``full`` (least, largest): who has ``largest`` links within its own block lies in a
    dense group, which is compared as a whole later; of another block it needs one
    neighbour, that its group hangs together, not a list.
    """

    def work(t: pa.Table) -> dict[str, np.ndarray]:
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
        x = unit_rows(t.column("v"))
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        across, dense = t.column("i")[0].as_py() != t.column("j")[0].as_py(), np.zeros(len(ids), bool)
        if across:
            same = own[:, None] == own[None, :]
            if full is not None:
                dense = ((sims >= full[0]) & same).sum(1) >= full[1]
            sims[same] = -2
        k = min(size, len(ids) - 1)
        if k < 1:
            return {"id": ids[:0], "other": ids[:0], "sim": np.zeros(0)}
        top = np.argpartition(-sims, k - 1, 1)[:, :k]
        s = np.take_along_axis(sims, top, 1)
        keep = (s >= floor) & (~dense[:, None] | (np.arange(k)[None, :] == s.argmax(1)[:, None]))
        rows, cols = np.nonzero(keep)
        return {"id": ids[rows], "other": ids[top[rows, cols]], "sim": s[rows, cols]}

    return work


def _count(least: float):
    """Work on a unit: each member's number of links (weighted) and an edge, to itself if it needs none."""

    def work(t: pa.Table) -> dict[str, np.ndarray]:
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
        x = unit_rows(t.column("v"))
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        parent = joining_edges(linked, own)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            linked &= own[:, None] != own[None, :]
        keep = linked.any(1)
        weight, up = t.column("weight").to_numpy(), parent[keep]
        return {"id": ids[keep], "parent": np.where(up < 0, ids[keep], ids[up]), "links": (linked @ weight)[keep].astype(np.int64),
            "pairs": linked.sum(1)[keep].astype(np.int64)}

    return work


def _compare(groups: DataFrame, vectors: DataFrame, size: int, floor: float, block: int, full: tuple[float, int]) -> DataFrame:
    """Neighbour lists from groups (g, h, id)."""
    units = block_pairs(groups, ["g", "h"], block).join(vectors.select("id", "v"), "id").select("g", "h", "i", "j", "id", "own", "v")
    return by_unit(units, ["g", "h", "i", "j"], _nearest(size, floor, full), LIST)


def _hoods(lists: DataFrame, vectors: DataFrame, size: int, floor: float) -> DataFrame:
    """Neighbour lists from joining each vector's neighbours, and itself, with one another: at most a list and one."""
    own = F.when(F.col("r") == 1, F.array("other", "id")).otherwise(F.array("other"))  # every listed id has a first neighbour
    members = lists.select(F.col("id").alias("h"), F.explode(own).alias("id"))
    one = [F.lit(0).alias(n) for n in ("i", "j", "own")]
    return by_unit(members.join(vectors.select("id", "v"), "id").select("h", *one, "id", "v"), ["h"], _nearest(size, floor), LIST)


def _best(fresh: DataFrame, lists: DataFrame | None, size: int) -> DataFrame:
    """Both directions of every pair, the ``size`` nearest of each vector kept: (id, other, sim, known, r).

    ``known`` tells the pairs that ``lists`` held, ``r`` a neighbour's rank.
    """
    pairs = fresh.select("id", "other", "sim", F.lit(False).alias("known"))
    if lists is not None:
        pairs = pairs.unionAll(lists.select("id", "other", "sim", F.lit(True).alias("known")))
    turned = pairs.unionAll(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"), "sim", "known"))
    turned = turned.groupBy("id", "other").agg(F.max("sim").alias("sim"), F.max("known").alias("known"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return turned.withColumn("r", rank).where(F.col("r") <= size)


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, size: int = 16, largest: int = 64,
        floor: float = 0.5, leaf: int = 64, block: int = 256,
    rounds: int = 5, settled: float = 0.002, expect: float = 0.95, recall: float = 0.97, audit: int = 400, extra_forests: int = 4,
        seed: int = 23,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links: other vectors linked directly, copies included; component_id: the
    smallest id reachable; kept: whether that is the row's own id. Vectors that
    are null, zero or hold a null or non-finite component link with nothing, nor
    do vectors of different dimension. Equal vectors are compared once. Rows
    that repeat an id are vectors of their own that share it; null ids take
    part under the smallest long and come back null. An empty table gives an
    empty result; other columns are ignored.

    The audit compares ``audit`` vectors, chosen by a hash, with all others; if none
    of them has a link 4 and then 16 times as many. Each counts once, and those of
    few links apart from those of many. Where ``1 + extra_forests`` forests do not reach ``recall``,
    an error is raised. A forest has as many trees as bring a pair at ``least``
    together with a chance of ``expect`` or ``recall``, whichever is higher.
    """
    lowest = F.lit(-(1 << 63))
    given = materialize(rows.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("id"),
        F.col(vector_col).cast("array<double>").alias("v")).withColumn("ok", usable("v")), "given")
    classes = given.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    vectors = materialize(classes.withColumn("dim", F.size("v")), "vectors")
    count = vectors.count()
    near = math.acos(least) / math.pi
    bits = max(1, math.ceil(math.log2(max(2, count / leaf))))
    trees = max(4, math.ceil(math.log(1 - max(expect, recall)) / math.log(1 - (1 - near) ** bits)))
    for size_of in (audit, 4 * audit, 16 * audit):  # where links are rare, until the sample holds some
        sample = [(r["id"], r["dim"], r["v"]) for r in first_by_hash(vectors, "id", size_of, count).collect()]
        truth = _exact_links(vectors, sample, least)
        if truth or size_of >= count:
            break
    lists = None
    for forest_no in range(1 + extra_forests):
        fresh = _compare(leaves(vectors, trees, bits, seed + forest_no), vectors, size, floor, block, (least, largest))
        now = held = size
        before, lists = lists, materialize(_best(fresh, lists, now), "lists")
        if before is not None:
            discard(before)
        for _ in range(rounds):
            better = materialize(_best(_hoods(lists, vectors, now, floor), lists, now), "lists")
            # a list is full of links if its last neighbour is one
            full = F.max((F.col("r") >= now) & (F.col("sim") >= least)).alias("full")
            state = better.agg(F.count_if(~F.col("known")).alias("change"), F.count("*").alias("total"), full).first()
            discard(lists)
            lists, held = better, now  # held: what the lists are cut to
            if state["full"] and now < largest:
                now *= 2  # some lists are full of links: let them hold more
            elif state["change"] <= settled * max(1, state["total"]):
                break
        links, edges = _links(lists, vectors, least, held, block)
        found_share = _recall(links, truth, size)
        if found_share >= recall:
            break
    else:
        raise RuntimeError(f"the audit found {found_share:.4f} of the links after {1 + extra_forests} forests, {recall} is asked for")
    labels = connected_components(edges, "near")
    rep = F.col("rep")
    found = vectors.join(links, "id", "left").join(labels, "id", "left").select("v", F.col("id").alias("rep"), "weight", "links",
        "component")
    out = given.select("id", F.when(F.col("ok"), F.col("v")).alias("v")).join(found, "v", "left")
    component = F.coalesce("component", rep, "id")
    back = lambda c: F.when(c != lowest, c)
    return out.select(
        back(F.col("id")).alias(id_col), F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).alias("n_links"),
            back(component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def _links(lists: DataFrame, vectors: DataFrame, least: float, now: int, block: int) -> tuple[DataFrame, DataFrame]:
    """((id, links, pairs), edges (a, b)), pairs being links without the copies: from the lists, but in blocks for groups in which a list is full."""
    linked = lists.where(F.col("sim") >= least)
    groups = connected_components(linked.select(F.col("id").alias("a"), F.col("other").alias("b")), "groups")
    full = linked.groupBy("id").count().where(F.col("count") >= now).select("id").join(groups, "id").select("component").distinct()
    dense = materialize(groups.join(full, "component").select(F.col("component").alias("h"), "id"), "dense")
    units = block_pairs(dense, ["h"], block).join(vectors.select("id", "v", "weight"), "id").select("h", "i", "j", "id", "own", "v",
        "weight")
    counted = materialize(by_unit(units, ["h", "i", "j"], _count(least), "id long, parent long, links long, pairs long"), "counted")
    listed = linked.join(dense.select("id"), "id", "left_anti")
    alone = listed.join(vectors.select(F.col("id").alias("other"), "weight"), "other").select("id", F.col("weight").alias("links"),
        F.lit(1).cast("long").alias("pairs"))
    links = alone.unionAll(counted.select("id", "links", "pairs")).groupBy("id").agg(F.sum("links").alias("links"),
        F.sum("pairs").alias("pairs"))
    edges = listed.select(F.col("id").alias("a"),
        F.col("other").alias("b")).unionAll(counted.where("id <> parent").select(F.col("id").alias("a"), F.col("parent").alias("b")))
    return materialize(links, "links"), edges


def _exact_links(vectors: DataFrame, sample: list[tuple[int, int, list[float]]], least: float) -> dict[int, int]:
    """How many different vectors each sampled one links with (none: absent), by comparison with all."""
    by_dim: dict[int, list] = {}
    for i, d, v in sample:
        by_dim.setdefault(d, []).append((i, v))
    queries = {d: (np.array([i for i, _ in x]), unit_rows(pa.array([v for _, v in x], pa.list_(pa.float64())))) for d, x in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ids = b.column("dim").to_numpy(), b.column("id").to_numpy()
            for d, (q, m) in queries.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    hit = m @ unit_rows(b.column("v").take(pa.array(at))).T >= least
                    hit &= q[:, None] != ids[at][None, :]
                    n = hit.sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(q[n > 0]), pa.array(n[n > 0])], ["id", "n"])

    got = in_batches(vectors.select("id", "dim", "v"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in got}


def _recall(links: DataFrame, truth: dict[int, int], few: int) -> float:
    """The mean share found of an audited vector's links: of those with fewer than ``few`` or of the others, whichever is lower."""
    if not truth:
        return 1.0
    wanted = links.sparkSession.createDataFrame([(i,) for i in truth], "id long")
    got = {r["id"]: r["pairs"] for r in links.join(F.broadcast(wanted), "id").collect()}
    shares = [[min(got.get(i, 0), n) / n for i, n in truth.items() if (n < few) == small] for small in (True, False)]
    return min(sum(x) / len(x) for x in shares if x)

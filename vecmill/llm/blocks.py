"""Comparing the members of groups in bounded blocks.

A group of any size is dealt into blocks by a hash of its members, and each
pair of blocks (a block with itself included) is one unit of work. So a unit
holds about twice ``block`` members however large its group is, and no pair of
members is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.common import in_batches


def block_pairs(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``members`` (keys, id) of groups of two or more, once for each pair of blocks (i <= j) that it takes part in.

    Adds ``i``, ``j`` and ``own``, the member's block.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks",
        F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = members.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.select(*keys, "id", "own", other.alias("x")).select(*keys, "id", "own", F.least("own", "x").alias("i"),
        F.greatest("own", "x").alias("j"))


def by_unit(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], dict[str, np.ndarray]], schema: str,
    flush: int = 4096) -> DataFrame:
    """``work`` applied to the rows of each combination of the (integer) keys.

    Rows are dealt by keys and sorted within partitions, so a task holds one
    unit at a time; results leave in batches of ``flush`` rows or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out, size = None, [], 0

        def pack() -> pa.RecordBatch:
            names = list(out[0])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in names], names)

        for batch in _with_end(batches):
            if batch is None:
                units = [rest] if rest is not None and rest.num_rows else []
            else:
                t = pa.Table.from_batches([batch])
                t = t if rest is None else pa.concat_tables([rest, t])
                change = np.zeros(max(0, t.num_rows - 1), bool)
                for k in keys:
                    v = t.column(k).to_numpy()
                    change |= v[1:] != v[:-1]
                cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
                units = [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
                rest = t.slice(cuts[-1])
            for u in units:
                found = work(u)
                n = len(next(iter(found.values())))
                if n:
                    out.append(found)
                    size += n
                if size >= flush:
                    yield pack()
                    out, size = [], 0
        if out:
            yield pack()

    return in_batches(rows.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _with_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: each row's parent in a spanning forest, itself at a root."""
    n = len(linked)
    parent, seen = np.arange(n), np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        edge = [root]
        while edge:
            v = edge.pop()
            fresh = np.flatnonzero(linked[v] & ~seen)
            parent[fresh] = v
            seen[fresh] = True
            edge.extend(fresh.tolist())
    return parent


def joining_edges(linked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix over the members of one or two blocks: each member's parent, or -1.

    Parents make a spanning forest where all members are of one block. With two
    blocks, whose inner links other units give, only what joins the
    blocks' own components is given: at most one link a component. So a dense
    group's edges are about as many as its members, not as its units' members.
    """
    out = np.full(len(linked), -1)
    if len(np.unique(own)) < 2:
        parent = forest(linked)
        return np.where(parent == np.arange(len(parent)), out, parent)
    inner = roots_of(forest(linked & (own[:, None] == own[None, :])))
    names, part = np.unique(inner, return_inverse=True)
    a, b = np.nonzero(linked & (own[:, None] != own[None, :]))
    _, first = np.unique(part[a] * len(names) + part[b], return_index=True)  # one link for each pair of components
    a, b = a[first], b[first]
    between = np.zeros((len(names), len(names)), bool)
    between[part[a], part[b]] = True
    up = forest(between)
    for x, y in zip(a, b, strict=True):
        if up[part[x]] == part[y] and up[part[x]] != part[x]:
            # a member may stand for its component once; components hold different members
            out[x] = y
    return out


def roots_of(parent: np.ndarray) -> np.ndarray:
    """Each member's root in a forest of parents."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up

"""Shared plumbing: tables in the cluster's shared folder, tokenizers, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a temporary folder is used, but only on a local
    master: on a cluster a machine-local folder would be invisible to others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/vecmill/{tag}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="vecmill-")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but runs the job once, compresses, keeps
    column pruning, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._vm_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
    most: int = 4 << 20) -> DataFrame:
    """``run`` over the rows' Arrow batches, of at most ``most`` bytes or a single row unless the session has a limit of its own.

    A batch lies in memory on both sides several times, and Spark's own limit is 64 MB.
    After a task its worker, which Spark keeps for others, gives free memory back.
    """
    spark = rows.sparkSession
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(most))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return rows.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A path as given, or the place of a file of the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def share(key: Column, part: float) -> Column:
    """Whether a row belongs to a share of all rows, chosen by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 31)) < int(min(1.0, part) * (1 << 31)) + 1


def first_by_hash(rows: DataFrame, key: str, most: int, count: int) -> DataFrame:
    """``most`` rows of ``count``, the first by a hash of the key.

    A share of about twice as many is cut out first, so that what meets in one
    task does not grow with the number of tasks before it.
    """
    some = rows.where(share(F.col(key), (2 * most + 100) / max(1, count)))
    h = F.pmod(F.xxhash64(F.col(key), F.lit("share")), F.lit(1 << 31))
    return some.orderBy(h, key).limit(most)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to) of all edges at once: larger roots hook onto smaller ones, paths are shortened, until nothing changes."""
    edges = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not edges:
        return
    ids, at = np.unique(np.concatenate(edges, 1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "to"])


def connected_components(edges: DataFrame, tag: str, max_rounds: int = 60, few: int = 100_000) -> DataFrame:
    """(id, component): the smallest id reachable over the edges (a, b).

    In each round every vertex moves to the one that comes first among itself
    and its neighbours, by a hash drawn anew each round, and edges follow their
    ends. So edges shrink by a factor a round, whatever a component's diameter,
    and all rounds together handle a small multiple of the edges given. The last ``few``
    edges are settled in one task, where further rounds would each cost several jobs. The
    moves are then put together backwards. Only joins and partially aggregated
    groupings are used, so a hub with a third of all edges is combined before
    it is shuffled and its joins are of the kind that Spark can split. Vertices
    without an edge do not appear.
    """
    ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialize(edges.select(ends.alias("e")).select("e.*").where("a <> b").distinct(), f"{tag}-edges")
    moves: list[DataFrame] = []
    while left := links.count():
        if left <= few:
            moves.append(materialize(in_batches(links.coalesce(1), _settle, "id long, to long"), f"{tag}-moves"))
            break
        if len(moves) == max_rounds:
            raise RuntimeError("components did not settle")
        place = lambda v, n=len(moves): F.struct(F.xxhash64(F.lit(n), v).alias("h"), v.alias("to"))
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("x")),
            F.struct(F.col("b").alias("id"), F.col("a").alias("x")))).alias("e")).select("e.*")
        first = both.groupBy("id").agg(F.min(place(F.col("x"))).alias("m"))
        move = materialize(first.select("id", F.least("m", place(F.col("id")))["to"].alias("to")), f"{tag}-moves")
        moved = links.join(move.select(F.col("id").alias("a"), F.col("to").alias("ta")),
            "a").join(move.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        fresh = materialize(moved.select(F.col("ta").alias("a"),
            F.col("tb").alias("b")).where("a <> b").select(ends.alias("e")).select("e.*").distinct(), f"{tag}-edges")
        discard(links)
        links = fresh
        moves.append(move)
    if not moves:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = moves[-1].select("id", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        up = roots.select(F.col("id").alias("to"), "root")
        roots = move.join(up, "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    roots = materialize(roots, f"{tag}-roots")
    discard(links, *moves)
    return roots.join(roots.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")

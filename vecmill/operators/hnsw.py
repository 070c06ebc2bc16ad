"""Layered proximity graphs, one for each shard of the rows.

Rows are dealt into shards of bounded size by a hash of their identity; each
shard's graph is built in one task and kept as one binary row. A search asks
every shard for its n best and merges them, so it is one scan of the graphs.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecmill.errors import InvalidArgument
from vecmill.operators.metrics import METRICS
from vecmill.operators.search import QUERY_BYTES
from vecmill.types import Hnsw

FILL_ROWS = 64  # ids of which distances to a whole shard are held at once
EXACT_BELOW = 4096  # so few accepted rows are compared one by one


@dataclass
class Graph:
    """Vectors by id, in layers; layer 0 holds all of them."""

    settings: Hnsw
    vectors: dict[int, np.ndarray] = field(default_factory=dict)
    layers: list[dict[int, list[int]]] = field(default_factory=list)
    entry: int | None = None
    #: By layer, who names an id; made for deletions and dropped by an insertion.
    _namers: list[dict[int, set[int]]] | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        if self.settings.maximum_connections <= 1:
            raise InvalidArgument("hnsw needs more than one connection")
        self.metric = METRICS[self.settings.metric]

    def _far(self, query: np.ndarray, ids: Sequence[int]) -> np.ndarray:
        """Distances, smaller is closer, whatever the metric."""
        v = np.concatenate([self.vectors[i] for i in ids]).reshape(len(ids), -1)
        if self.metric.name in ("euclidean", "squared_euclidean"):
            v -= query
            s = np.einsum("ij,ij->i", v, v)
            s = np.sqrt(s) if self.metric.name == "euclidean" else s
        else:
            s = self.metric.matrix(query[None, :], v)[0]
            s = -s if self.metric.greater_is_closer else s
        s[np.isnan(s)] = np.inf
        return s

    def level_of(self, key: int) -> int:
        """The same for an id wherever it is inserted: exponentially fewer ids reach each higher layer."""
        share = ((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 11) / float(1 << 53)
        return int(-np.log(max(share, 2.0**-53)) / np.log(self.settings.maximum_connections))

    def _room(self, level: int) -> int:
        return self.settings.maximum_connections_zero if level == 0 else self.settings.maximum_connections

    def reach(self, query: np.ndarray, starts: Sequence[int], width: int, level: int,
        accept: set[int] | None = None) -> list[tuple[float, int]]:
        """The ``width`` closest found from the starts on; ids that are not accepted are passed through, not returned."""
        seen = set(starts)
        far = self._far(query, starts)
        frontier = [(d, i) for d, i in zip(far.tolist(), starts, strict=True)]
        heapq.heapify(frontier)
        best = [(-d, i) for d, i in frontier if accept is None or i in accept]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while frontier:
            d, i = heapq.heappop(frontier)
            if len(best) == width and d > -best[0][0]:
                break
            fresh = [n for n in self.layers[level].get(i, ()) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, n in zip(self._far(query, fresh).tolist(), fresh, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(frontier, (e, n))
                    if accept is None or n in accept:
                        heapq.heappush(best, (-e, n))
                        if len(best) > width:
                            heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def spread(self, found: Sequence[tuple[float, int]], room: int) -> list[int]:
        """Neighbours in different directions: one is left out if it lies closer to a chosen one than to the centre."""
        if not found:
            return []
        v = np.stack([self.vectors[i] for _, i in found])
        between, far = self._between(v, v), np.array([d for d, _ in found])
        left, kept = np.ones(len(found), bool), []
        while len(kept) < room and (at := int(left.argmax())) < len(left) and left[at]:
            kept.append(found[at][1])
            left &= between[at] >= far
            left[: at + 1] = False
        return kept

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all pairs, smaller is closer; of Euclidean ones by a product, as only neighbours' choice hangs on them."""
        if self.metric.name in ("euclidean", "squared_euclidean"):
            s = -2 * (a @ b.T)
            s += np.einsum("ij,ij->i", a, a)[:, None]
            s += np.einsum("ij,ij->i", b, b)
            np.maximum(s, 0, out=s)
            s = np.sqrt(s, out=s) if self.metric.name == "euclidean" else s
        else:
            s = self.metric.matrix(a, b)
            s = -s if self.metric.greater_is_closer else s
        s[np.isnan(s)] = np.inf
        return s

    def insert(self, key: int, vector: Sequence[float]) -> bool:
        """False, and no change, for an id that is there."""
        if key in self.vectors:
            return False
        self._namers = None
        v = np.asarray(vector, np.float64)
        self.vectors[key] = v
        top = self.level_of(key)
        starts = [] if self.entry is None else [self.entry]
        for level in range(len(self.layers) - 1, -1, -1):
            if level > top:
                starts = [self.reach(v, starts, 1, level)[0][1]]
                continue
            found = self.reach(v, starts, self.settings.ef_construction, level)
            self._link(key, found, level)
            starts = [i for _, i in found] or starts
        while len(self.layers) <= top:
            self.layers.append({key: []})
            self.entry = key
        return True

    def _link(self, key: int, found: Sequence[tuple[float, int]], level: int) -> None:
        near = self.spread(found, self.settings.maximum_connections)
        layer = self.layers[level]
        layer[key] = near
        for n in near:
            layer[n] = [*layer[n], key]
            if len(layer[n]) > self._room(level):
                far = self._far(self.vectors[n], layer[n])
                layer[n] = self.spread(sorted(zip(far.tolist(), layer[n], strict=True)), self._room(level))

    def fill(self, ids: Sequence[int], vectors: np.ndarray) -> None:
        """Insert into an empty graph: each id is linked as by ``insert``, but to the true nearest of those before it.

        These are found by matrix products, a few ids at a time, instead of by walks through the graph.
        """
        ids, first = np.unique(np.asarray(ids, np.int64), return_index=True)
        order = np.argsort(first, kind="stable")
        ids, v = ids[order], np.asarray(vectors, np.float64)[first[order]]
        keys, width = ids.tolist(), self.settings.ef_construction
        tops = np.array([self.level_of(i) for i in keys], int)
        for s in range(0, len(keys), FILL_ROWS):
            end = min(len(keys), s + FILL_ROWS)
            apart = self._between(v[s:end], v[:end])
            for at in range(s, end):
                key, top = keys[at], int(tops[at])
                self.vectors[key] = v[at]
                for level in range(min(top, len(self.layers) - 1), -1, -1):
                    before = np.flatnonzero(tops[:at] >= level) if level else np.arange(at)
                    far = apart[at - s, before]
                    if len(before) > width:
                        before = before[np.argpartition(far, width)[:width]]
                    near = ids[before].tolist()
                    exact = self._far(v[at], near).tolist() if near else []
                    self._link(key, sorted(zip(exact, near, strict=True)), level)
                while len(self.layers) <= top:
                    self.layers.append({key: []})
                    self.entry = key

    def delete(self, key: int) -> bool:
        if self.vectors.pop(key, None) is None:
            return False
        if self._namers is None:
            self._namers = [{} for _ in self.layers]
            for layer, namers in zip(self.layers, self._namers, strict=True):
                for n, others in layer.items():
                    for o in others:
                        namers.setdefault(o, set()).add(n)
        for layer, namers in zip(self.layers, self._namers, strict=False):
            gone = layer.pop(key, None)
            if gone is None:
                continue
            for o in gone:
                namers.get(o, set()).discard(key)
            for n in namers.pop(key, ()):  # its neighbours are offered one another
                others = layer[n]
                offered = [o for o in dict.fromkeys([*others, *gone]) if o not in (key, n) and o in layer]
                far = self._far(self.vectors[n], offered) if offered else np.zeros(0)
                layer[n] = self.spread(sorted(zip(far.tolist(), offered, strict=True)), max(self.settings.maximum_connections, len(others)))
                for o in set(others) - set(layer[n]) - {key}:
                    namers.get(o, set()).discard(n)
                for o in layer[n]:
                    namers.setdefault(o, set()).add(n)
        while self.layers and not self.layers[-1]:
            self.layers.pop()
        if self.entry == key:
            self.entry = next(iter(self.layers[-1])) if self.layers else None
        return True

    def nearest(self, query: Sequence[float], n: int, width: int | None = None, accept: set[int] | None = None) -> list[tuple[float, int]]:
        """(score, id), closest first. Few accepted ids are compared exactly."""
        q = np.asarray(query, np.float64)
        if self.entry is None or accept is not None and not accept:
            return []
        if accept is not None and len(accept) <= EXACT_BELOW:
            ids = [i for i in accept if i in self.vectors]
            found = sorted(zip(self._far(q, ids).tolist(), ids, strict=True))[:n] if ids else []
        else:
            start = [self.entry]
            for level in range(len(self.layers) - 1, 0, -1):
                start = [self.reach(q, start, 1, level)[0][1]]
            found = self.reach(q, start, max(n, width or 50), 0, accept)[:n]
        return [(-d if self.metric.greater_is_closer else d, i) for d, i in found]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, all of one dimension and none null."""
    n = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0)
    return flat.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def to_bytes(g: Graph) -> bytes:
    """A graph as an Arrow stream: a row for each id, with its vector and its neighbours in each layer that it is in."""
    ids = list(g.vectors)
    links = [[layer[i] for layer in g.layers if i in layer] for i in ids]
    dims = np.cumsum([0, *(len(g.vectors[i]) for i in ids)])
    flat = np.concatenate([g.vectors[i] for i in ids]) if ids else np.zeros(0)
    t = pa.table({"id": pa.array(ids, pa.int64()), "vector": pa.ListArray.from_arrays(pa.array(dims, pa.int32()), pa.array(flat)),
        "links": pa.array(links, pa.list_(pa.list_(pa.int64())))})
    facts = {"settings": json.dumps(asdict(g.settings)), "entry": json.dumps(g.entry)}
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema.with_metadata(facts)) as w:
        w.write_table(t.replace_schema_metadata(facts))
    return out.getvalue().to_pybytes()


def from_bytes(data: bytes) -> Graph:
    t = pa.ipc.open_stream(data).read_all()
    facts = {k.decode(): json.loads(v) for k, v in t.schema.metadata.items()}
    g = Graph(Hnsw(**facts["settings"]), entry=facts["entry"])
    for i, v, links in zip(t.column("id").to_pylist(), _matrix(t.column("vector")), t.column("links").to_pylist(), strict=True):
        g.vectors[i] = v
        for level, others in enumerate(links):
            if level == len(g.layers):
                g.layers.append({})
            g.layers[level][i] = others
    return g


def shard_count(rows: DataFrame, shard_rows: int = 20_000) -> int:
    return max(1, -(-rows.count() // shard_rows))


def build_graphs(rows: DataFrame, path: str, settings: Hnsw, shard_rows: int = 20_000, key: str = "key",
    shards: int | None = None) -> DataFrame:
    """Write (shard, n, graph) for rows (key_id, key), in ``shards`` shards, by default of about ``shard_rows`` each."""
    shards = shards or shard_count(rows, shard_rows)
    dealt = rows.select(F.pmod(F.xxhash64("key_id"), F.lit(shards)).cast("long").alias("shard"), "key_id", F.col(key).alias("key"))

    def build(t: pa.Table) -> pa.Table:
        g = Graph(settings)
        g.fill(t.column("key_id").to_numpy(), _matrix(t.column("key")))
        return pa.table({"shard": t.column("shard").slice(0, 1), "n": pa.array([len(g.vectors)]),
            "graph": pa.array([to_bytes(g)], pa.binary())})

    dealt.groupBy("shard").applyInArrow(build, "shard long, n long, graph binary").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def update_graphs(graphs: DataFrame, change: DataFrame, path: str, settings: Hnsw, shards: int) -> DataFrame:
    """The graphs after a change (key_id, key, alive): deletions first, then insertions of ids that are not there.

    Only the shards of changed ids are taken apart; the others are copied as they are.
    """
    dealt = change.select(F.pmod(F.xxhash64("key_id"), F.lit(shards)).cast("long").alias("shard"), "key_id", "key", "alive")

    def apply(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return old
        g: Graph = from_bytes(old.column("graph")[0].as_py()) if old.num_rows else Graph(settings)
        alive = np.asarray(new.column("alive"))
        ids, fresh = new.column("key_id").to_numpy(), new.filter(pa.array(alive))
        for i in ids[~alive].tolist():
            g.delete(i)
        if not g.vectors:
            g.fill(fresh.column("key_id").to_numpy(), _matrix(fresh.column("key")))
        else:
            for i, v in zip(fresh.column("key_id").to_pylist(), _matrix(fresh.column("key")), strict=True):
                g.insert(i, v)
        return pa.table({"shard": new.column("shard").slice(0, 1), "n": pa.array([len(g.vectors)]),
            "graph": pa.array([to_bytes(g)], pa.binary())})

    graphs.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(apply, "shard long, n long, graph binary").write.parquet(path)
    return graphs.sparkSession.read.parquet(path)


def search_graphs_many(graphs: DataFrame, queries: DataFrame, k: int, width: int | None = None, query_id: str = "query_id",
    query_key: str = "query") -> DataFrame:
    """(query_id, key_id, similarity, rank): the k best of every query, each shard's graph being loaded once.

    Queries travel to every task; more than ``QUERY_BYTES`` of them are refused, to be given in parts.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_key).cast("array<double>").alias("x")).collect()
    if sum(len(r["x"]) for r in asked) * 8 > QUERY_BYTES:
        raise InvalidArgument("too many queries for one search")
    given = graphs.sparkSession.sparkContext.broadcast([(r["q"], np.array(r["x"])) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("graph"):
                g: Graph = from_bytes(data.as_py())
                found = [(q, i, s, s if g.metric.greater_is_closer else -s) for q, x in given.value for s, i in g.nearest(x, k, width)]
                cols = list(zip(*found, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    ["q", "r", "similarity", "closeness"])

    found = graphs.select("graph").mapInArrow(run, "q long, r long, similarity double, closeness double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("closeness"), F.desc("r")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("r").alias("key_id"),
        "similarity", "rank")


def search_graphs(graphs: DataFrame, query: Sequence[float], n: int, width: int | None = None, accept: DataFrame | None = None,
    shards_of: int | None = None) -> DataFrame:
    """(key_id, similarity), closest first. ``accept``: (key_id) of the rows that may be returned; ``shards_of``: into how many shards ids were dealt."""
    if n <= 0:
        raise InvalidArgument("closest_n must be above 0")
    q = [float(x) for x in query]
    shards = graphs
    if accept is not None:
        total = shards_of or (graphs.agg(F.max("shard")).first()[0] or 0) + 1
        ids = accept.select(F.pmod(F.xxhash64("key_id"), F.lit(total)).cast("long").alias("shard"),
            "key_id").groupBy("shard").agg(F.collect_list("key_id").alias("ids"))  # a shard's rows at most
        shards = graphs.join(ids, "shard")
    else:
        shards = graphs.withColumn("ids", F.lit(None).cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, ids in zip(b.column("graph"), b.column("ids"), strict=True):
                g: Graph = from_bytes(data.as_py())
                found = g.nearest(q, n, width, None if ids.as_py() is None else set(ids.as_py()))
                greater = g.metric.greater_is_closer
                yield pa.RecordBatch.from_arrays([pa.array([i for _, i in found], pa.int64()),
                    pa.array([s for s, _ in found], pa.float64()), pa.array([s if greater else -s for s, _ in found], pa.float64())],
                        ["key_id", "similarity", "closeness"])

    return shards.select("graph", "ids").mapInArrow(run,
        "key_id long, similarity double, closeness double").orderBy(F.desc("closeness"), F.desc("key_id")).limit(n).drop("closeness")

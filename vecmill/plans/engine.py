"""The engine: a catalog of stores and the execution of commands.

Reads return lazy DataFrames that Catalyst plans. Writes check everything
first, then put a small change over a store's rows (see ``operators.mutations``);
after ``compact_every`` changes the rows are written anew, so neither plans nor
reads grow with the number of writes.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill import __version__, storage
from vecmill.errors import AlreadyExists, DimensionMismatch, EngineError, InvalidArgument, NonLinearIndexNotFound, PredicateNotFound, StoreNotFound
from vecmill.functions.vectors import key_id, map_bytes
from vecmill.operators import hnsw
from vecmill.operators import mutations as M
from vecmill.operators.metrics import METRICS
from vecmill.operators.postings import posting_counts
from vecmill.operators.predicates import Predicate, compile_predicate
from vecmill.operators.search import knn_join, top_n
from vecmill.plans import commands as C
from vecmill.plans.dsl import parse
from vecmill.sources import snapshot
from vecmill.types import DEFAULT_SCHEMA, STORE_ROW, VALUE, VECTOR, Hnsw, KdTree, Meta, StoreMeta


@dataclass
class Graphs:
    """The layered graphs of a store's rows."""

    rows: DataFrame
    shards: int
    path: str


@dataclass
class Store:
    """``rows``: the ``base`` with the changes in ``layers`` put over it, one after another."""

    meta: StoreMeta
    rows: DataFrame
    graphs: Graphs | None = None
    layers: list[tuple[DataFrame, str]] = field(default_factory=list)
    #: The base's files if they are the engine's own, and files that rows were made of before, which readers may still hold.
    files: list[str] = field(default_factory=list)
    outdated: list[str] = field(default_factory=list)
    #: The snapshot whose files hold the base.
    snapshot: str | None = None

    def __post_init__(self):
        self.rebase(self.rows)

    def rebase(self, rows: DataFrame, *files: str) -> None:
        """New rows, of these files, without changes over them."""
        self.outdated += self.files + [path for _, path in self.layers]
        self.rows, self.base, self.base_rows, self.layers, self.files = rows, rows, None, [], list(files)


@dataclass(frozen=True)
class SetResult:
    inserted: int
    updated: int


@dataclass(frozen=True)
class Count:
    count: int


@dataclass
class Engine:
    """``semantics``: how predicates judge rows without the key; see ``operators.predicates``."""

    spark: SparkSession
    semantics: str = "direct"
    compact_every: int = 8
    #: Whether anything changed since the last snapshot.
    dirty: bool = False
    stores: dict[str, dict[str, Store]] = field(default_factory=dict)

    # -- catalog

    @staticmethod
    def schema_name(schema: str | None) -> str:
        if schema is None:
            return DEFAULT_SCHEMA
        if not schema:
            raise InvalidArgument("a schema's name must not be empty")
        return schema

    def store(self, name: str, schema: str | None = None) -> Store:
        found = self.stores.get(self.schema_name(schema), {}).get(name)
        if found is None:
            raise StoreNotFound(name)
        return found

    def create_store(self, name: str, dimension: int, predicates: Sequence[str] = (), nonlinear: Sequence[KdTree | Hnsw] = (),
        error_if_exists: bool = True, schema: str | None = None) -> None:
        """An existing store keeps its settings when ``error_if_exists`` is off."""
        where = self.schema_name(schema)
        if dimension <= 0:
            raise InvalidArgument("a dimension must be above 0")
        if name in self.stores.get(where, {}):
            if error_if_exists:
                raise AlreadyExists(name)
            return
        meta = StoreMeta(name, where, dimension, set(predicates), set(), {})
        for index in nonlinear:
            meta.nonlinear.setdefault(index.algorithm, index)
        self.stores.setdefault(where, {})[name] = Store(meta, self.spark.createDataFrame([], STORE_ROW))
        self.dirty = True

    def attach(self, name: str, rows: DataFrame, dimension: int, predicates: Sequence[str] = (),
        nonlinear: Sequence[KdTree | Hnsw] = (), schema: str | None = None) -> Store:
        """A store whose rows are a table (key, value) with a row for each key; nothing is read or copied."""
        self.create_store(name, dimension, predicates, nonlinear, schema=schema)
        s = self.store(name, schema)
        value = F.col("value").cast(VALUE).alias("value")
        s.rebase(rows.select(key_id(F.col("key")).alias("key_id"), F.col("key").cast(VECTOR).alias("key"), value))
        s.meta.posted |= s.meta.predicates
        return s

    def drop_store(self, name: str, error_if_not_exists: bool = True, schema: str | None = None) -> Count:
        if self.stores.get(self.schema_name(schema), {}).pop(name, None) is None:
            if error_if_not_exists:
                raise StoreNotFound(name)
            return Count(0)
        self.dirty = True
        return Count(1)

    def drop_schema(self, schema: str) -> Count:
        if self.schema_name(schema) == DEFAULT_SCHEMA:
            raise InvalidArgument(f"schema {DEFAULT_SCHEMA} cannot be dropped")
        self.dirty = True
        return Count(len(self.stores.pop(schema, {})))

    def list_stores(self, schema: str | None = None) -> DataFrame:
        """(name, schema, len, size_in_bytes, dimension, predicates, nonlinear), by name."""
        return self._info(list(self.stores.get(schema or DEFAULT_SCHEMA, {}).values())).orderBy("name")

    def get_store(self, name: str, schema: str | None = None) -> DataFrame:
        return self._info([self.store(name, schema)])

    def _info(self, stores: list[Store]) -> DataFrame:
        fields = "name string, schema string, dimension int, predicates array<string>, nonlinear array<string>, len long, size_in_bytes long"
        out = self.spark.createDataFrame([], fields)
        for s in stores:
            m = s.meta
            one = s.rows.agg(F.count("*").alias("len"),
                F.coalesce(F.sum(m.dimension * 4 + map_bytes(F.col("value"))), F.lit(0)).cast("long").alias("size_in_bytes"))
            names = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<string>")
            out = out.unionByName(one.select(F.lit(m.name).alias("name"), F.lit(m.schema).alias("schema"),
                F.lit(m.dimension).alias("dimension"), names(m.predicates).alias("predicates"), names(m.nonlinear).alias("nonlinear"),
                    "len", "size_in_bytes"))
        return out

    # -- indexes

    def create_pred_index(self, name: str, predicates: Sequence[str], schema: str | None = None) -> Count:
        meta = self.store(name, schema).meta
        fresh = set(predicates) - meta.predicates
        meta.predicates |= fresh
        meta.posted |= fresh
        self.dirty = True
        return Count(len(fresh))

    def drop_pred_index(self, name: str, predicates: Sequence[str], error_if_not_exists: bool = True, schema: str | None = None) -> Count:
        meta = self.store(name, schema).meta
        gone = set(predicates) & meta.predicates
        if error_if_not_exists and (missing := [p for p in predicates if p not in meta.predicates]):
            raise PredicateNotFound(missing[0])
        meta.predicates -= gone
        meta.posted -= gone
        self.dirty = True
        return Count(len(gone))

    def create_nonlinear_index(self, name: str, indices: Sequence[KdTree | Hnsw], schema: str | None = None) -> Count:
        """One index for each algorithm; an existing one keeps its settings."""
        meta, made = self.store(name, schema).meta, 0
        for index in indices:
            if isinstance(index, Hnsw) and (index.maximum_connections <= 1 or index.metric not in METRICS):
                raise InvalidArgument("hnsw needs more than one connection and a known metric")
            made += index.algorithm not in meta.nonlinear
            meta.nonlinear.setdefault(index.algorithm, index)
        self.dirty = True
        return Count(made)

    def drop_nonlinear_index(self, name: str, algorithms: Sequence[str], error_if_not_exists: bool = True,
        schema: str | None = None) -> Count:
        meta = self.store(name, schema).meta
        if error_if_not_exists and (missing := [a for a in algorithms if a not in meta.nonlinear]):
            raise NonLinearIndexNotFound(missing[0])
        s = self.store(name, schema)
        if "hnsw" in algorithms and s.graphs is not None:
            s.outdated.append(s.graphs.path)
            s.graphs = None
        self.dirty = True
        return Count(sum(meta.nonlinear.pop(a, None) is not None for a in dict.fromkeys(algorithms)))

    def postings(self, name: str, schema: str | None = None) -> DataFrame:
        s = self.store(name, schema)
        return posting_counts(s.rows, s.meta.predicates)

    # -- reads

    def rows(self, name: str, schema: str | None = None) -> DataFrame:
        return self.store(name, schema).rows

    def _condition(self, s: Store, condition: Predicate | None, semantics: str | None = None):
        return compile_predicate(condition, semantics=semantics or self.semantics, posted=s.meta.posted)

    def _keys(self, s: Store, keys: Sequence[Sequence[float]]) -> DataFrame:
        for k in keys:
            if len(k) != s.meta.dimension:
                raise DimensionMismatch(s.meta.dimension, len(k))
        wanted = self.spark.createDataFrame([(i, [float(x) for x in k]) for i, k in enumerate(keys)], "pos long, wanted array<float>")
        return wanted.select("pos", key_id(F.col("wanted")).alias("key_id"), F.col("wanted").alias("key"))

    def get_key(self, name: str, keys: Sequence[Sequence[float]], schema: str | None = None) -> DataFrame:
        """(key, value) in the order asked for; unknown keys are left out, keys asked for twice come twice."""
        s = self.store(name, schema)
        return self._keys(s, keys).join(s.rows, M.IDENTITY).orderBy("pos").select("key", "value")

    def get_pred(self, name: str, condition: Predicate, schema: str | None = None) -> DataFrame:
        s = self.store(name, schema)
        if condition is None:
            raise InvalidArgument("a condition is needed")
        return s.rows.where(self._condition(s, condition)).select("key", "value")

    def get_sim_n(self, name: str, query: Sequence[float], closest_n: int, algorithm: str = "cosine",
        condition: Predicate | None = None, schema: str | None = None) -> DataFrame:
        """(key, value, similarity), closest first. kdtree gives squared distances, hnsw its index's metric; both are exact."""
        s = self.store(name, schema)
        if closest_n <= 0:
            raise InvalidArgument("closest_n must be above 0")
        if len(query) != s.meta.dimension:
            raise DimensionMismatch(s.meta.dimension, len(query))
        if self.semantics == "indexed" and algorithm in ("kdtree", "hnsw") and algorithm not in s.meta.nonlinear and condition is not None:
            # by postings, a condition that accepts nothing ends the search before an index is looked for
            accepted = s.rows.where(self._condition(s, condition))
            if not accepted.limit(1).count():
                return accepted.select("key", "value", F.lit(None).cast("double").alias("similarity"))
        by, semantics = self._metric(s, algorithm)
        where = self._condition(s, condition, semantics) if condition is not None else None
        return top_n(s.rows, query, closest_n, by, where).select("key", "value", "similarity")

    def _metric(self, s: Store, algorithm: str) -> tuple[str, str]:
        """The metric, and how predicates are judged: linear searches always judge rows directly."""
        if algorithm in ("kdtree", "hnsw"):
            index = s.meta.nonlinear.get(algorithm)
            if index is None:
                raise NonLinearIndexNotFound(algorithm)
            return ("squared_euclidean" if algorithm == "kdtree" else index.metric), self.semantics
        if algorithm not in METRICS:
            raise InvalidArgument(f"no such algorithm: {algorithm}")
        return algorithm, "direct"

    def knn(self, name: str, queries: DataFrame, k: int, algorithm: str = "cosine", condition: Predicate | None = None,
        schema: str | None = None) -> DataFrame:
        """(query_id, key_id, similarity, rank) for queries (query_id, query), all in one plan."""
        s = self.store(name, schema)
        by, semantics = self._metric(s, algorithm)
        rows = s.rows if condition is None else s.rows.where(self._condition(s, condition, semantics))
        return knn_join(queries, rows.select("key_id", "key"), k, by, keep_self=True)

    # -- layered graphs

    def graphs(self, name: str, schema: str | None = None) -> Graphs:
        """The graphs of a store's hnsw index: built when they are first asked for, kept up with every change from then on."""
        s = self.store(name, schema)
        index = s.meta.nonlinear.get("hnsw")
        if index is None:
            raise NonLinearIndexNotFound("hnsw")
        if s.graphs is None:
            path, shards = storage.fresh_path(self.spark, "graphs"), hnsw.shard_count(s.rows)
            s.graphs = Graphs(hnsw.build_graphs(s.rows.select("key_id", "key"), path, index, shards=shards), shards, path)
        return s.graphs

    def approximate(self, name: str, query: Sequence[float], closest_n: int, condition: Predicate | None = None,
        width: int | None = None, schema: str | None = None) -> DataFrame:
        """As ``get_sim_n`` by hnsw, but from the graphs: a few thousand distances a shard instead of one for each row."""
        s, g = self.store(name, schema), self.graphs(name, schema)
        if len(query) != s.meta.dimension:
            raise DimensionMismatch(s.meta.dimension, len(query))
        accept = None if condition is None else s.rows.where(self._condition(s, condition)).select("key_id")
        found = hnsw.search_graphs(g.rows, query, closest_n, width, accept, g.shards)
        order = F.asc("similarity") if not METRICS[s.meta.nonlinear["hnsw"].metric].greater_is_closer else F.desc("similarity")
        return found.join(s.rows, "key_id").orderBy(order, F.desc("key_id")).select("key", "value", "similarity")

    # -- writes

    def _apply(self, s: Store, change: DataFrame, path: str | None = None) -> None:
        """Put a change over a store's rows; ``path``: where it is already written."""
        if path is None:
            path = storage.fresh_path(self.spark, "change")
            change = storage.written(change, path)
        if s.graphs is not None:
            new = storage.fresh_path(self.spark, "graphs")
            s.graphs, old = Graphs(hnsw.update_graphs(s.graphs.rows, change, new, s.meta.nonlinear["hnsw"], s.graphs.shards),
                s.graphs.shards, new), s.graphs
            s.outdated.append(old.path)
        s.rows = M.overlay(s.rows, change)
        s.layers.append((change, path))
        self.dirty = True
        if len(s.layers) >= self.compact_every:
            self.compact(s)

    def compact(self, s: Store) -> None:
        """Merge the changes into one; where that is a quarter of the base or more, write the rows anew.

        What they were made of goes at the next such time, as readers may still hold it.
        """
        if not s.layers:
            return
        for old in s.outdated:
            storage.remove(self.spark, old)
        s.outdated = []
        path = storage.fresh_path(self.spark, "change")
        merged = storage.written(M.merged_changes([c for c, _ in s.layers]), path)
        if s.base_rows is None:
            s.base_rows = s.base.count()
        if 4 * merged.count() < s.base_rows:
            s.outdated += [old for _, old in s.layers]
            s.rows, s.layers = M.overlay(s.base, merged), [(merged, path)]
        else:
            whole = storage.fresh_path(self.spark, "store")
            s.rebase(storage.written(M.overlay(s.base, merged), whole), whole)
            s.outdated.append(path)
            s.snapshot = None

    def set(self, name: str, given: DataFrame | Sequence[tuple], schema: str | None = None, replaced: DataFrame | None = None) -> SetResult:
        """Insert or replace. ``given``: (key, value) pairs, or a DataFrame (pos, key, value). Rows in ``replaced`` go in the same change.

        The batch is written once, and judged as it lies there: a key of another dimension takes all of it back.
        """
        s = self.store(name, schema)
        frame = given if isinstance(given, DataFrame) else M.entries(self.spark, given)
        path = storage.fresh_path(self.spark, "change")
        new = storage.written(M.set_change(M.batch(frame)), path)
        unposted = sorted(s.meta.predicates - s.meta.posted)
        carried = [F.max(F.map_contains_key("value", p)).alias(f"p{i}") for i, p in enumerate(unposted)]
        facts = new.agg(F.max(F.when(F.size("key") != s.meta.dimension, F.size("key"))).alias("wrong"), *carried).first()
        if facts["wrong"] is not None:
            storage.remove(self.spark, path)
            raise DimensionMismatch(s.meta.dimension, facts["wrong"])
        rows = s.rows
        if replaced is not None:
            gone = storage.persist(replaced.select(*M.IDENTITY), "gone")
            rows = rows.join(gone, M.IDENTITY, "left_anti")
            gone = M.delete_change(gone.join(new, M.IDENTITY, "left_anti"))
        inserted, updated = M.set_counts(rows, new)
        s.meta.posted |= {p for i, p in enumerate(unposted) if facts[f"p{i}"]}
        if replaced is None:
            self._apply(s, new, path)
        else:
            self._apply(s, new.unionByName(gone))
        return SetResult(inserted, updated)

    def upsert(self, name: str, condition: Predicate, new_key: Sequence[float] | None = None,
        new_value: dict[str, Meta | str] | None = None, merge: bool = False, schema: str | None = None) -> SetResult:
        s = self.store(name, schema)
        if new_key is None and new_value is None:
            raise InvalidArgument("an upsert needs a new key or a new value")
        self._apply(s, M.upsert_change(s.rows, self._condition(s, condition), s.meta.dimension, new_key, new_value, merge))
        s.meta.posted |= s.meta.predicates & set(new_value or {})
        return SetResult(0, 1)

    def del_key(self, name: str, keys: Sequence[Sequence[float]], schema: str | None = None) -> Count:
        s = self.store(name, schema)
        if not keys:
            return Count(0)
        return self._delete(s, s.rows.select(*M.IDENTITY).join(self._keys(s, keys).select(*M.IDENTITY), M.IDENTITY, "left_semi"))

    def del_pred(self, name: str, condition: Predicate, schema: str | None = None) -> Count:
        s = self.store(name, schema)
        if condition is None:
            raise InvalidArgument("a condition is needed")
        return self._delete(s, s.rows.where(self._condition(s, condition)).select(*M.IDENTITY))

    def _delete(self, s: Store, gone: DataFrame) -> Count:
        path = storage.fresh_path(self.spark, "change")
        change = storage.written(M.delete_change(gone), path)
        n = change.count()
        if n:
            self._apply(s, change, path)
        else:
            storage.remove(self.spark, path)
        return Count(n)

    # -- snapshots

    def write_snapshot(self, path: str) -> None:
        """In place of what is at ``path``; stores that were read from there go on from the new files."""
        stores = [s for group in self.stores.values() for s in group.values()]
        snapshot.write(self.spark, [(s.meta, s.rows) for s in stores], path)
        self.dirty = False
        for number, s in enumerate(stores):
            if s.snapshot == path:
                s.rebase(snapshot.rows_of(self.spark, path, number))

    def snapshot_if_changed(self, path: str) -> bool:
        """Whether a snapshot was written: only if anything changed since the last one."""
        if not self.dirty:
            return False
        self.write_snapshot(path)
        return True

    def snapshot_every(self, seconds: float, path: str) -> Callable[[], None]:
        """Snapshots in the background, when anything changed; the result ends them, after a last one."""
        over = threading.Event()

        def loop() -> None:
            while not over.wait(seconds):
                self.snapshot_if_changed(path)

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()

        def end() -> None:
            over.set()
            thread.join()
            self.snapshot_if_changed(path)

        return end

    def read_snapshot(self, path: str) -> None:
        """In place of what the engine holds. The rows stay in the snapshot's files until they change."""
        self.stores = {}
        for meta, rows in snapshot.read(self.spark, path):
            self.stores.setdefault(meta.schema, {})[meta.name] = Store(meta, rows, snapshot=path)

    def export_service_snapshot(self) -> dict:
        """A document of all stores, for stores of up to 100,000 rows; ``write_service_snapshot`` takes any."""
        return snapshot.to_service_json([(s.meta, s.rows) for stores in self.stores.values() for s in stores.values()])

    def import_service_snapshot(self, document: dict) -> None:
        for schema, stores in snapshot.parse_service_json(document).items():
            for name, store in stores.items():
                self._import_store(schema, name, store, snapshot.service_rows(store))

    def _import_store(self, schema: str, name: str, store: dict, rows: DataFrame | list) -> None:
        self.create_store(name, int(store["dimension"]), error_if_exists=False, schema=schema)
        if isinstance(rows, DataFrame) or rows:
            self.set(name, rows, schema)
        indices = store.get("predicate_indices") or {}
        if names := indices.get("allowed_predicates"):
            self.create_pred_index(name, names, schema)

    def write_service_snapshot(self, path: str, flat: bool = False) -> None:
        """The document of all stores as files, for stores of any size: only what stands around the rows passes through the driver."""
        stores = [(s.meta, s.rows) for group in self.stores.values() for s in group.values()]
        snapshot.write_service_lines(self.spark, stores, path, flat)

    def read_service_snapshot(self, path: str) -> None:
        """Import what ``write_service_snapshot`` wrote."""
        document, held = snapshot.read_service_lines(self.spark, path)
        described = snapshot.parse_service_json(document)
        for schema, name, rows in held:
            self._import_store(schema, name, described[schema][name], rows)

    # -- commands

    def cluster_info(self) -> DataFrame:
        """(node, role, state): the driver and the executors that it knows."""
        sc = self.spark.sparkContext
        known = sc._jsc.sc().getExecutorMemoryStatus().keys().toList()
        driver = f"{sc.getConf().get('spark.driver.host', 'localhost')}:{sc.getConf().get('spark.driver.port', '')}"
        rows = [(driver, "driver", "running")]
        names = [known.apply(i) for i in range(known.size())]
        rows += [(n, "executor", "running") for n in sorted(names) if n != driver]
        return self.spark.createDataFrame(rows, "node string, role string, state string")

    def info(self) -> DataFrame:
        sc = self.spark.sparkContext
        return self.spark.createDataFrame([(sc.master, __version__, self.spark.version, "database")],
            "address string, version string, spark string, type string")

    def execute(self, command: C.Command):
        match command:
            case C.Ping():
                return "pong"
            case C.InfoServer():
                return self.info()
            case C.ListClients():
                return self.spark.createDataFrame([(self.spark.sparkContext.applicationId,)], "client string")
            case C.ClusterInfo():
                return self.cluster_info()
            case C.ListStores():
                return self.list_stores(command.schema)
            case C.GetStore():
                return self.get_store(command.store, command.schema)
            case C.CreateStore(s, d, p, n, e, schema):
                return self.create_store(s, d, p, n, e, schema)
            case C.DropStore(s, e, schema):
                return self.drop_store(s, e, schema)
            case C.DropSchema():
                return self.drop_schema(command.schema)
            case C.CreatePredIndex(s, p, schema):
                return self.create_pred_index(s, p, schema)
            case C.DropPredIndex(s, p, e, schema):
                return self.drop_pred_index(s, p, e, schema)
            case C.CreateNonLinearIndex(s, i, schema):
                return self.create_nonlinear_index(s, i, schema)
            case C.DropNonLinearIndex(s, a, e, schema):
                return self.drop_nonlinear_index(s, a, e, schema)
            case C.GetKey(s, k, schema):
                return self.get_key(s, k, schema)
            case C.GetPred(s, c, schema):
                return self.get_pred(s, c, schema)
            case C.GetSimN(s, q, n, a, c, schema):
                return self.get_sim_n(s, q, n, a, c, schema)
            case C.Set(s, e, schema):
                return self.set(s, e, schema)
            case C.Upsert(s, c, k, v, m, schema):
                return self.upsert(s, c, k, v, m, schema)
            case C.DelKey(s, k, schema):
                return self.del_key(s, k, schema)
            case C.DelPred(s, c, schema):
                return self.del_pred(s, c, schema)
        raise InvalidArgument(f"no such command here: {type(command).__name__}")

    def pipeline(self, given: Sequence[C.Command | None] | Callable) -> list:
        """Results in order; a command that fails leaves its error in its place and the rest go on."""
        if any(c is None for c in given):
            raise InvalidArgument("a pipeline's commands must not be empty")
        out = []
        for c in given:
            try:
                out.append(self.execute(c))
            except EngineError as e:
                out.append(e)
        return out

    def query(self, source: str, quotes: bool = True) -> list:
        return self.pipeline(parse(source, quotes=quotes))

    def with_semantics(self, semantics: str) -> Engine:
        """The same stores, judged otherwise."""
        return replace(self, semantics=semantics)

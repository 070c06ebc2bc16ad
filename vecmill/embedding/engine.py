"""Stores of raw inputs: models in front of an engine's stores of vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill import storage
from vecmill.embedding.models import Registry
from vecmill.errors import EngineError, InvalidArgument
from vecmill.functions.vectors import without
from vecmill.operators.predicates import In, Predicate
from vecmill.plans import commands as C
from vecmill.plans.dsl import parse
from vecmill.plans.engine import Count, Engine, SetResult, Store
from vecmill.types import META, VALUE, Hnsw, KdTree, Meta

#: Metadata keys that the engine keeps to itself.
ORIGINAL = "_vecmill_input"
PART = "_vecmill_part"


def _on(provider: str | None, params: dict[str, str]) -> dict[str, str]:
    """The parameters, with the execution provider that a model may heed."""
    return params if provider is None else params | {"execution_provider": provider}


@dataclass
class AiEngine:
    engine: Engine
    models: Registry

    def _store(self, name: str, schema: str | None) -> Store:
        s = self.engine.store(name, schema)
        if s.meta.index_model is None:
            raise InvalidArgument(f"store {name} holds vectors, not raw inputs")
        return s

    # -- catalog

    def create_store(self, name: str, query_model: str, index_model: str, predicates: Sequence[str] = (),
        nonlinear: Sequence[KdTree | Hnsw] = (), error_if_exists: bool = True, store_original: bool = False,
            schema: str | None = None) -> None:
        q, i = self.models.spec(query_model), self.models.spec(index_model)
        if q.dimension != i.dimension:
            raise InvalidArgument(f"models {query_model} and {index_model} make vectors of {q.dimension} and {i.dimension} numbers")
        if {ORIGINAL, PART} & set(predicates):
            raise InvalidArgument("reserved names cannot be indexed")
        known = name in self.engine.stores.get(self.engine.schema_name(schema), {})
        names = [*predicates, *[ORIGINAL] * store_original, *[PART] * i.one_to_many]
        self.engine.create_store(name, i.dimension, names, nonlinear, error_if_exists, schema)
        if not known:
            meta = self.engine.store(name, schema).meta
            meta.query_model, meta.index_model, meta.store_original = query_model, index_model, store_original

    def list_stores(self, schema: str | None = None) -> DataFrame:
        """The stores of raw inputs with their models, and what is known of their vectors."""
        stores = [s for s in self.engine.stores.get(schema or "public", {}).values() if s.meta.index_model]
        return self._info(stores, self.engine._info(stores)).orderBy("name")

    def get_store(self, name: str, schema: str | None = None) -> DataFrame:
        s = self._store(name, schema)
        return self._info([s], self.engine._info([s]))

    def _info(self, stores: list[Store], vectors: DataFrame) -> DataFrame:
        own = self.engine.spark.createDataFrame([(s.meta.name, s.meta.query_model, s.meta.index_model,
            s.meta.store_original) for s in stores], "name string, query_model string, index_model string, store_original boolean")
        hidden = F.array(F.lit(ORIGINAL), F.lit(PART))
        return own.join(vectors, "name", "left").withColumn("predicates", F.array_except("predicates", hidden))

    def purge_stores(self) -> Count:
        n = 0
        for schema, stores in self.engine.stores.items():
            for name in [k for k, s in stores.items() if s.meta.index_model]:
                n += self.engine.drop_store(name, schema=schema).count
        return Count(n)

    def drop_pred_index(self, name: str, predicates: Sequence[str], error_if_not_exists: bool = True, schema: str | None = None) -> Count:
        return self.engine.drop_pred_index(name, [p for p in predicates if p not in (ORIGINAL, PART)], error_if_not_exists, schema)

    # -- reads

    def _shown(self, rows: DataFrame, *more: str) -> DataFrame:
        """(key, value, ...): the original input as key, reserved entries hidden."""
        return rows.select(F.try_element_at("value", F.lit(ORIGINAL)).alias("key"),
            without(F.col("value"), ORIGINAL, PART).alias("value"), *more)

    def _by_inputs(self, s: Store, inputs: Sequence[Meta]) -> Predicate:
        if not s.meta.store_original:
            raise InvalidArgument(f"store {s.meta.name} does not keep originals")
        return In(ORIGINAL, tuple(inputs))

    def get_key(self, name: str, inputs: Sequence[Meta], schema: str | None = None) -> DataFrame:
        s = self._store(name, schema)
        return self._shown(self.engine.get_pred(name, self._by_inputs(s, inputs), schema))

    def get_pred(self, name: str, condition: Predicate, schema: str | None = None) -> DataFrame:
        self._store(name, schema)
        return self._shown(self.engine.get_pred(name, condition, schema))

    def _one(self, model: str, given: Meta, preprocess: bool, params: dict | None) -> list[float]:
        found = self.models.embed(model, [given], preprocess, params)[0]
        if len(found) != 1:
            raise InvalidArgument(f"the query gives {len(found)} embeddings, not one")
        return [float(x) for x in found[0][0]]

    def get_sim_n(self, name: str, query: Meta, closest_n: int, algorithm: str = "cosine", condition: Predicate | None = None,
        preprocess: bool = True, params: dict | None = None, schema: str | None = None) -> DataFrame:
        s = self._store(name, schema)
        vector = self._one(s.meta.query_model, query, preprocess, params)
        return self._shown(self.engine.get_sim_n(name, vector, closest_n, algorithm, condition, schema), "similarity")

    # -- writes

    def inputs_frame(self, pairs: Sequence[tuple[Meta, dict[str, Meta | str] | None]]) -> DataFrame:
        rows = [(n, x.as_row(), {k: Meta.of(v).as_row() for k, v in (m or {}).items()}) for n, (x, m) in enumerate(pairs)]
        return self.engine.spark.createDataFrame(rows, f"pos long, input {META.simpleString()}, value {VALUE.simpleString()}")

    def set(self, name: str, given: DataFrame | Sequence[tuple], preprocess: bool = True, params: dict | None = None,
        schema: str | None = None) -> SetResult:
        """Embed and set; where originals are kept, an input set again replaces all its vectors."""
        s = self._store(name, schema)
        frame = given if isinstance(given, DataFrame) else self.inputs_frame(given)
        reserved = F.exists(F.map_keys("value"), lambda k: k.isin(ORIGINAL, PART))
        if frame.where(reserved).limit(1).count():
            raise InvalidArgument("reserved names cannot be set")
        made = storage.persist(self.models.embed_frame(frame, s.meta.index_model, preprocess, params), "embedded")
        own = []
        if s.meta.store_original:
            own.append(F.create_map(F.lit(ORIGINAL), F.col("input")))
        if self.models.spec(s.meta.index_model).one_to_many:
            number = F.struct(F.lit("str").alias("kind"), F.col("number").cast("string").alias("str"),
                F.lit(None).cast("binary").alias("bin"))
            own.append(F.create_map(F.lit(PART), number))
        value = F.map_concat("value", *own) if own else F.col("value")
        old = None
        if s.meta.store_original:  # the old vectors of these inputs go in the change that brings the new ones
            old = s.rows.join(frame.select(F.col("input").alias("x")).distinct(),
                F.try_element_at("value", F.lit(ORIGINAL)) == F.col("x"), "left_semi")
        order = (F.col("pos") * 65536 + F.col("number")).alias("pos")
        return self.engine.set(name, made.select(order, "key", value.alias("value")), schema, old)

    def upsert(self, name: str, condition: Predicate, new_input: Meta | None = None, new_value: dict | None = None,
        preprocess: bool = True, params: dict | None = None, schema: str | None = None) -> SetResult:
        """Values are always merged; models that make several vectors cannot be upserted."""
        s = self._store(name, schema)
        if self.models.spec(s.meta.index_model).one_to_many:
            raise InvalidArgument("models of several embeddings cannot be upserted")
        value = dict(new_value or {})
        key = None
        if new_input is not None:
            key = self._one(s.meta.index_model, new_input, preprocess, params)
            if s.meta.store_original:
                value[ORIGINAL] = new_input
        return self.engine.upsert(name, condition, key, value or None, True, schema)

    def del_key(self, name: str, inputs: Sequence[Meta], schema: str | None = None) -> Count:
        s = self._store(name, schema)
        return self.engine.del_pred(name, self._by_inputs(s, inputs), schema)

    def convert(self, inputs: Sequence[Meta], model: str, preprocess: bool = True, params: dict | None = None) -> DataFrame:
        """(pos, input, number, key, value): embeddings without a store."""
        return self.models.embed_frame(self.inputs_frame([(x, {}) for x in inputs]), model, preprocess, params)

    # -- commands

    def execute(self, command: C.Command):
        match command:
            case C.AiCreateStore(s, q, i, p, n, e, o, schema):
                return self.create_store(s, q, i, p, n, e, o, schema)
            case C.AiSet(s, x, pre, provider, params, schema):
                return self.set(s, x, pre, _on(provider, params), schema)
            case C.AiGetKey(s, x, schema):
                return self.get_key(s, x, schema)
            case C.AiDelKey(s, x, schema):
                return self.del_key(s, x, schema)
            case C.GetPred(s, c, schema):
                return self.get_pred(s, c, schema)
            case C.AiGetSimN(s, q, n, a, c, pre, provider, params, schema):
                return self.get_sim_n(s, q, n, a, c, pre, _on(provider, params), schema)
            case C.AiUpsert(s, c, x, v, pre, provider, params, schema):
                return self.upsert(s, c, x, v, pre, _on(provider, params), schema)
            case C.PurgeStores():
                return self.purge_stores()
            case C.ConvertInputs(x, m, pre, params):
                return self.convert(x, m, pre, params)
            case C.ListStores():
                return self.list_stores(command.schema)
            case C.GetStore():
                return self.get_store(command.store, command.schema)
            case C.DropPredIndex(s, p, e, schema):
                return self.drop_pred_index(s, p, e, schema)
        return self.engine.execute(command)

    def pipeline(self, given: Sequence[C.Command]) -> list:
        out = []
        for c in given:
            try:
                out.append(self.execute(c))
            except EngineError as e:
                out.append(e)
        return out

    def query(self, source: str, quotes: bool = True) -> list:
        return self.pipeline(parse(source, ai=True, quotes=quotes))

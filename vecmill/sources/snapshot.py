"""Snapshots of stores: our own (Parquet and a description) and the JSON files of the service."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecmill import storage
from vecmill.functions.codec import from_tagged, to_tagged
from vecmill.types import DEFAULT_SCHEMA, META, STORE_ROW, VALUE, Hnsw, KdTree, Meta, StoreMeta

FORMAT = 1


def describe(meta: StoreMeta) -> dict:
    out = asdict(meta) | {"predicates": sorted(meta.predicates), "posted": sorted(meta.posted)}
    return out | {"nonlinear": [{"algorithm": k} | asdict(v) for k, v in sorted(meta.nonlinear.items())]}


def undescribe(d: dict) -> StoreMeta:
    kinds = {"kdtree": KdTree, "hnsw": Hnsw}
    nonlinear = {x["algorithm"]: kinds[x["algorithm"]](**{k: v for k, v in x.items() if k != "algorithm"}) for x in d["nonlinear"]}
    return StoreMeta(**d | {"predicates": set(d["predicates"]), "posted": set(d["posted"]), "nonlinear": nonlinear})


def write(spark: SparkSession, stores: list[tuple[StoreMeta, DataFrame]], path: str) -> None:
    """All stores, complete or not at all: written beside ``path``, then moved there."""
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    listed = []
    for number, (meta, rows) in enumerate(stores):
        rows.write.parquet(f"{draft}/stores/{number}")
        listed.append((number, json.dumps(describe(meta))))
    spark.createDataFrame([(FORMAT, n, d) for n, d in listed] or [(FORMAT, -1, "")],
        "format int, number int, description string").coalesce(1).write.json(f"{draft}/catalog")
    storage.move(spark, draft, path)


def read(spark: SparkSession, path: str) -> list[tuple[StoreMeta, DataFrame]]:
    listed = spark.read.schema("format int, number int, description string").json(f"{path}/catalog").orderBy("number").collect()
    if any(r["format"] != FORMAT for r in listed):
        raise ValueError(f"unknown snapshot format in {path}")
    return [(undescribe(json.loads(r["description"])), rows_of(spark, path, r["number"])) for r in listed if r["number"] >= 0]


def rows_of(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(STORE_ROW).parquet(f"{path}/stores/{number}")


def parse_service_json(document: dict) -> dict[str, dict[str, dict]]:
    """{schema: {store: description}} of a snapshot document.

    Version 2 nests stores in schemas under ``stores``; the old form is flat,
    its stores belong to the default schema; a nested form without a version
    is taken as well.
    """
    body = document["stores"] if "db_version" in document or set(document) == {"stores"} else document
    is_store = lambda x: isinstance(x, dict) and "dimension" in x
    if all(is_store(x) for x in body.values()):
        return {DEFAULT_SCHEMA: body}
    return {schema: stores for schema, stores in body.items()}


def service_rows(store: dict) -> list[tuple[list[float], dict[str, Meta]]]:
    """(key, metadata) of a store of a snapshot document; identities are made anew from the keys."""
    held = store.get("id_to_value", {})
    rows = []
    for pair in held.values() if isinstance(held, dict) else (x[-1] for x in held):
        key, value = pair
        if isinstance(value, dict) and set(value) == {"value"}:
            value = value["value"]
        rows.append(([float(x) for x in (key["key"] if isinstance(key, dict) else key)],
            {k: from_tagged(v) if isinstance(v, str) else Meta.of(v) for k, v in value.items()}))
    return rows


def to_service_json(stores: list[tuple[StoreMeta, DataFrame]], most_rows: int = 100_000) -> dict:
    """A snapshot document (version 2) of small stores; larger ones, refused here, are for ``write_service_lines``, as a document is one object in memory."""
    out: dict[str, dict] = {}
    for meta, rows in stores:
        held = rows.limit(most_rows + 1).collect()
        if len(held) > most_rows:
            raise ValueError(f"store {meta.name} has more than {most_rows} rows: write it to files instead")
        value = lambda m: {k: to_tagged(Meta(v["kind"], v["str"] if v["kind"] == "str" else bytes(v["bin"]))) for k,
            v in sorted(m.items())}
        entries = {str(r["key_id"] % (1 << 64)): [list(r["key"]), value(r["value"])] for r in held}
        out.setdefault(meta.schema, {})[meta.name] = {"dimension": meta.dimension, "id_to_value": entries,
            "predicate_indices": {"allowed_predicates": sorted(meta.predicates)}}
    return {"db_version": "2", "stores": out}


def write_service_lines(spark: SparkSession, stores: list[tuple[StoreMeta, DataFrame]], path: str, flat: bool = False) -> None:
    """The document in pieces, for stores of any size: the files below ``path``, in the order of their names, are one document.

    Pieces of even numbers are what stands around the entries, those of odd numbers a store's entries, one
    a line, written where the rows lie. ``flat``: the old form, without schemas and version.
    """
    if flat and any(meta.schema != DEFAULT_SCHEMA for meta, _ in stores):
        raise ValueError("the flat form has no schemas")
    mark, out = uuid.uuid4().hex, {}
    for meta, _ in stores:
        out.setdefault(meta.schema, {})[meta.name] = {"dimension": meta.dimension, "id_to_value": {mark: 0},
            "predicate_indices": {"allowed_predicates": sorted(meta.predicates)}}
    document = out.get(DEFAULT_SCHEMA, {}) if flat else {"db_version": "2", "stores": out}
    held = {(meta.schema, meta.name): rows for meta, rows in stores}
    listed = [held[schema, name] for schema, group in out.items() for name in group]
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    for number, around in enumerate(json.dumps(document).split(f'"{mark}": 0')):
        storage.put_bytes(spark, f"{draft}/{2 * number:08d}", around.encode())
        if number < len(listed):
            _entry_lines(listed[number]).write.text(f"{draft}/{2 * number + 1:08d}")
    storage.move(spark, draft, path)


def _entry_lines(rows: DataFrame) -> DataFrame:
    """``"id":[key,value]`` lines; all but the smallest id's begin with a comma. JSON has no line ends within texts."""
    least = rows.agg(F.min("key_id")).first()[0]
    number = F.col("key_id").cast("decimal(20,0)")
    unsigned = F.when(number < 0, number + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(number).cast("decimal(20,0)").cast("string")
    comma = F.when(F.col("key_id") == F.lit(least), "").otherwise(",")
    return tagged_json(rows).select(F.concat(comma, F.lit('"'), unsigned, F.lit('":['), F.to_json("key"), F.lit(","), "value",
        F.lit("]")).alias("value"))


def read_service_lines(spark: SparkSession, path: str) -> tuple[dict, list[tuple[str, str, DataFrame]]]:
    """What ``write_service_lines`` wrote: the document without entries (small, on the driver), and (schema, store, rows (pos, key, value)) of each store."""
    pieces = storage.names(spark, path)
    document = json.loads("".join(spark.read.text(f"{path}/{n}", wholetext=True).first()[0] for n in pieces[::2]))
    listed = [(schema, name) for schema, stores in parse_service_json(document).items() for name in stores]
    return document, [(*at, _entries_of(spark.read.text(f"{path}/{n}"))) for at, n in zip(listed, pieces[1::2], strict=True)]


def _entries_of(lines: DataFrame) -> DataFrame:
    pair = F.map_values(F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")), "map<string, array<string>>"))[0]
    held = lines.select(pair[0].alias("key"), pair[1].alias("value")).select(F.from_json("key", "array<float>").alias("key"),
        F.from_json("value", "map<string, string>").alias("value"))
    plain = F.forall(F.map_values("value"), lambda v: v.startswith("str:"))
    pos = F.lit(0).cast("long").alias("pos")
    said = F.transform_values("value", lambda _, v: F.struct(F.lit("str").alias("kind"), F.substring(v, 5, 2**31 - 1).alias("str"),
        F.lit(None).cast("binary").alias("bin")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[(k, dict(zip(META.names, from_tagged(v).as_row(), strict=True))) for k, v in m] for m in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, to_arrow_type(VALUE))], ["key", "value"])

    others = held.where(~plain).mapInArrow(run, f"key array<float>, value {VALUE.simpleString()}")
    return held.where(plain).select(pos, "key", said.cast(VALUE).alias("value")).unionByName(others.select(pos, "key", "value"))


def tagged_json(rows: DataFrame) -> DataFrame:
    """(key_id, key, value) with value as JSON of tagged strings, as snapshots write it. Only rows that hold bytes pass through Python."""
    plain = F.forall(F.map_values("value"), lambda v: v["kind"] == "str")
    tagged = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values("value", lambda _,
        v: F.concat(F.lit("str:"), v["str"]))))))
    texts = rows.where(plain).select("key_id", "key", F.when(F.size("value") == 0, "{}").otherwise(tagged).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [json.dumps({k: to_tagged(Meta(v["kind"], v["str"] if v["kind"] == "str" else bytes(v["bin"]))) for k,
                v in sorted(m)}, ensure_ascii=False, separators=(",", ":")) for m in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key_id"), b.column("key"), pa.array(out, pa.string())], ["key_id", "key", "value"])

    others = rows.where(~plain).select("key_id", "key", "value").mapInArrow(run, "key_id long, key array<float>, value string")
    return texts.unionByName(others)

"""Changes of a store's rows. Each takes rows and returns rows; nothing is altered in place.

A change is a small table of *what is new for a key* (``alive`` tells a row
from a deletion). Putting it over the rows is one anti-join on the key's
identity and a union, so its cost follows the change, not the store. The identity is
the hash and the vector: the hash tells zeros of either sign apart, and two
vectors of one hash stay two rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.errors import DimensionMismatch, UpsertMismatch
from vecmill.functions.vectors import key_id, merged
from vecmill.types import STORE_ROW, VALUE, VECTOR, Meta

#: What two rows of one vector share.
IDENTITY = ["key_id", "key"]


def entries(spark: SparkSession, pairs: Sequence[tuple[Sequence[float] | None, dict[str, Meta | str] | None]]) -> DataFrame:
    """(pos, key, value) from Python pairs, in their order."""
    rows = [(i, None if k is None else [float(x) for x in k], {n: Meta.of(v).as_row() for n, v in (m or {}).items()}) for i,
        (k, m) in enumerate(pairs)]
    schema = f"pos long, key array<float>, value {VALUE.simpleString()}"
    return spark.createDataFrame(rows, schema)


def batch(given: DataFrame) -> DataFrame:
    """(key_id, key, value) of a batch (pos, key, value); dimensions are the caller's to judge.

    Entries without a key drop out, those without a value get an empty map; of repeated keys the last stays.
    """
    value = F.coalesce("value", F.create_map().cast(VALUE)).alias("value")
    keyed = given.where(F.col("key").isNotNull()).select("pos", F.col("key").cast(VECTOR).alias("key"), value)
    keyed = keyed.withColumn("key_id", key_id(F.col("key")))
    last = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.desc("pos")))
    return keyed.withColumn("n", last).where("n = 1").select("key_id", "key", "value")


def overlay(rows: DataFrame, change: DataFrame) -> DataFrame:
    """``rows`` with a change (key_id, key, value, alive) put over them."""
    kept = rows.join(change.select(*IDENTITY), IDENTITY, "left_anti")
    return kept.select(*STORE_ROW.names).unionByName(change.where("alive").select(*STORE_ROW.names))


def merged_changes(changes: Sequence[DataFrame]) -> DataFrame:
    """One change that does what these do one after another: of each key the last."""
    numbered = [c.select(*STORE_ROW.names, "alive", F.lit(n).alias("nth")) for n, c in enumerate(changes)]
    every = numbered[0]
    for c in numbered[1:]:
        every = every.unionAll(c)
    last = F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.desc("nth")))
    return every.withColumn("n", last).where("n = 1").select(*STORE_ROW.names, "alive")


def set_change(new: DataFrame) -> DataFrame:
    return new.select("key_id", "key", "value", F.lit(True).alias("alive"))


def delete_change(gone: DataFrame) -> DataFrame:
    """A change that deletes the rows of these keys (key_id, key); their old content does not matter."""
    return gone.select(*IDENTITY, F.create_map().cast(VALUE).alias("value"), F.lit(False).alias("alive"))


def set_counts(rows: DataFrame, new: DataFrame) -> tuple[int, int]:
    """(inserted, updated) if the batch ``new`` is set."""
    seen = new.select(*IDENTITY).join(rows.select(*IDENTITY).withColumn("old", F.lit(True)), IDENTITY, "left")
    r = seen.agg(F.count("*").alias("n"), F.count("old").alias("u")).first()
    return r["n"] - r["u"], r["u"]


def upsert_change(rows: DataFrame, condition: Column, dimension: int, new_key: Sequence[float] | None,
    new_value: dict[str, Meta | str] | None, merge: bool) -> DataFrame:
    """The change of an update of the one row that meets the condition; everything is checked first."""
    spark = rows.sparkSession
    hit = rows.where(condition)
    found = hit.limit(2).collect()
    if len(found) != 1:
        raise UpsertMismatch(hit.count() if found else 0)
    old = spark.createDataFrame(found, STORE_ROW)
    if new_key is not None:
        if len(new_key) != dimension:
            raise DimensionMismatch(dimension, len(new_key))
        key = F.array(*[F.lit(float(x)) for x in new_key]).cast(VECTOR)
        old_key = F.array(*[F.lit(float(x)) for x in found[0]["key"]]).cast(VECTOR)
        other = (F.col("key_id") != found[0]["key_id"]) | (F.col("key") != old_key)
        taken = rows.join(old.select(key_id(key).alias("key_id"), key.alias("key")), IDENTITY, "left_semi").where(other).limit(1).count()
        if taken:
            raise UpsertMismatch(2)
    else:
        key = F.col("key")
    value = F.col("value")
    if new_value is not None:
        fresh = entries(spark, [([0.0], new_value)]).select(F.col("value").alias("fresh"))
        old = old.join(F.broadcast(fresh))  # one row with one row
        value = merged(F.col("value"), F.col("fresh")) if merge else F.col("fresh")
    new = old.select(key_id(key).alias("key_id"), key.alias("key"), value.alias("value"), F.lit(True).alias("alive"))
    if new_key is None:
        return new
    gone = delete_change(spark.createDataFrame(found, STORE_ROW))
    return gone.join(new.select(*IDENTITY), IDENTITY, "left_anti").unionByName(new)

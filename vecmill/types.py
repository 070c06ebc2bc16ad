"""The data model: rows of stores, metadata values and store descriptions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Nullable throughout, as columns read from files are: operators check what they are given.
META = T.StructType([T.StructField("kind", T.StringType()), T.StructField("str", T.StringType()), T.StructField("bin", T.BinaryType())])
VECTOR = T.ArrayType(T.FloatType())
VALUE = T.MapType(T.StringType(), META)
#: A store's rows. ``key_id`` is a hash of the vector's bit pattern, the identity of a row.
STORE_ROW = T.StructType([T.StructField("key_id", T.LongType()), T.StructField("key", VECTOR), T.StructField("value", VALUE)])

DEFAULT_SCHEMA = "public"


@dataclass(frozen=True)
class Meta:
    """A metadata value or raw input: a text, an image or a sound. The kind is part of its identity."""

    kind: str
    data: str | bytes

    def __post_init__(self):
        if self.kind not in ("str", "img", "aud") or isinstance(self.data, str) != (self.kind == "str"):
            raise ValueError(f"no such value: {self.kind} {type(self.data).__name__}")

    @classmethod
    def of(cls, value: Meta | str) -> Meta:
        return value if isinstance(value, Meta) else cls("str", value)

    def as_row(self) -> tuple:
        return (self.kind, self.data, None) if self.kind == "str" else (self.kind, None, bytearray(self.data))


def text(value: str) -> Meta:
    return Meta("str", value)


def image(data: bytes) -> Meta:
    return Meta("img", bytes(data))


def audio(data: bytes) -> Meta:
    return Meta("aud", bytes(data))


@dataclass(frozen=True)
class KdTree:
    """Exact search by squared Euclidean distance."""

    algorithm = "kdtree"


@dataclass(frozen=True)
class Hnsw:
    """Search by the index's own metric. Graph settings are recorded, as they steer nothing here."""

    metric: str = "euclidean"
    ef_construction: int = 100
    maximum_connections: int = 16
    maximum_connections_zero: int = 32
    extend_candidates: bool = False
    keep_pruned_connections: bool = False
    algorithm = "hnsw"


@dataclass
class StoreMeta:
    name: str
    schema: str
    dimension: int
    predicates: set[str] = field(default_factory=set)
    #: keys whose postings exist: indexed keys that a row has carried, or that were indexed later
    posted: set[str] = field(default_factory=set)
    nonlinear: dict[str, KdTree | Hnsw] = field(default_factory=dict)
    # of stores of raw inputs
    query_model: str | None = None
    index_model: str | None = None
    store_original: bool = False

"""Commands: what the query language parses to and an engine executes."""

from __future__ import annotations

from dataclasses import dataclass, field

from vecmill.operators.predicates import Predicate
from vecmill.types import Hnsw, KdTree, Meta

Key = tuple[float, ...]


@dataclass(frozen=True)
class Command:
    pass


@dataclass(frozen=True)
class Ping(Command):
    pass


@dataclass(frozen=True)
class InfoServer(Command):
    pass


@dataclass(frozen=True)
class ListClients(Command):
    pass


@dataclass(frozen=True)
class ClusterInfo(Command):
    pass


@dataclass(frozen=True)
class ListStores(Command):
    schema: str | None = None


@dataclass(frozen=True)
class GetStore(Command):
    store: str
    schema: str | None = None


@dataclass(frozen=True)
class CreateStore(Command):
    store: str
    dimension: int
    predicates: tuple[str, ...] = ()
    nonlinear: tuple[KdTree | Hnsw, ...] = ()
    error_if_exists: bool = True
    schema: str | None = None


@dataclass(frozen=True)
class DropStore(Command):
    store: str
    error_if_not_exists: bool = True
    schema: str | None = None


@dataclass(frozen=True)
class DropSchema(Command):
    schema: str


@dataclass(frozen=True)
class CreatePredIndex(Command):
    store: str
    predicates: tuple[str, ...]
    schema: str | None = None


@dataclass(frozen=True)
class DropPredIndex(Command):
    store: str
    predicates: tuple[str, ...]
    error_if_not_exists: bool = True
    schema: str | None = None


@dataclass(frozen=True)
class CreateNonLinearIndex(Command):
    store: str
    indices: tuple[KdTree | Hnsw, ...]
    schema: str | None = None


@dataclass(frozen=True)
class DropNonLinearIndex(Command):
    store: str
    algorithms: tuple[str, ...]
    error_if_not_exists: bool = True
    schema: str | None = None


@dataclass(frozen=True)
class GetKey(Command):
    store: str
    keys: tuple[Key, ...]
    schema: str | None = None


@dataclass(frozen=True)
class GetPred(Command):
    store: str
    condition: Predicate
    schema: str | None = None


@dataclass(frozen=True)
class GetSimN(Command):
    store: str
    query: Key
    closest_n: int
    algorithm: str = "cosine"
    condition: Predicate | None = None
    schema: str | None = None


@dataclass(frozen=True)
class Set(Command):
    store: str
    entries: tuple[tuple[Key | None, dict[str, Meta] | None], ...]
    schema: str | None = None


@dataclass(frozen=True)
class Upsert(Command):
    store: str
    condition: Predicate
    new_key: Key | None = None
    new_value: dict[str, Meta] | None = None
    merge: bool = False
    schema: str | None = None


@dataclass(frozen=True)
class DelKey(Command):
    store: str
    keys: tuple[Key, ...]
    schema: str | None = None


@dataclass(frozen=True)
class DelPred(Command):
    store: str
    condition: Predicate
    schema: str | None = None


# Commands of stores of raw inputs


@dataclass(frozen=True)
class AiCreateStore(Command):
    store: str
    query_model: str
    index_model: str
    predicates: tuple[str, ...] = ()
    nonlinear: tuple[KdTree | Hnsw, ...] = ()
    error_if_exists: bool = True
    store_original: bool = False
    schema: str | None = None


@dataclass(frozen=True)
class AiSet(Command):
    store: str
    inputs: tuple[tuple[Meta, dict[str, Meta]], ...]
    preprocess: bool = True
    provider: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    schema: str | None = None


@dataclass(frozen=True)
class AiGetKey(Command):
    store: str
    inputs: tuple[Meta, ...]
    schema: str | None = None


@dataclass(frozen=True)
class AiDelKey(Command):
    store: str
    inputs: tuple[Meta, ...]
    schema: str | None = None


@dataclass(frozen=True)
class AiGetSimN(Command):
    store: str
    query: Meta
    closest_n: int
    algorithm: str = "cosine"
    condition: Predicate | None = None
    preprocess: bool = True
    provider: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    schema: str | None = None


@dataclass(frozen=True)
class AiUpsert(Command):
    store: str
    condition: Predicate
    new_input: Meta | None = None
    new_value: dict[str, Meta] | None = None
    preprocess: bool = True
    provider: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    schema: str | None = None


@dataclass(frozen=True)
class PurgeStores(Command):
    pass


@dataclass(frozen=True)
class ConvertInputs(Command):
    inputs: tuple[Meta, ...]
    model: str
    preprocess: bool = True
    params: dict[str, str] = field(default_factory=dict)

"""Errors, each with the numeric status code that its service call would carry."""

from __future__ import annotations


class EngineError(Exception):
    code = 13

    def as_dict(self) -> dict:
        return {"message": str(self), "code": self.code}


class InvalidArgument(EngineError):
    code = 3


class NotFound(EngineError):
    code = 5


class StoreNotFound(NotFound):
    def __init__(self, store: str):
        super().__init__(f"there is no store {store}")


class PredicateNotFound(NotFound):
    def __init__(self, name: str):
        super().__init__(f"{name} is not indexed in this store")


class NonLinearIndexNotFound(NotFound):
    def __init__(self, name: str):
        super().__init__(f"the store has no {name} index")


class AlreadyExists(EngineError):
    code = 6

    def __init__(self, store: str):
        super().__init__(f"there is a store {store} already")


class DimensionMismatch(InvalidArgument):
    def __init__(self, expected: int, found: int | None):
        super().__init__(f"the store holds vectors of {expected} numbers, not {found}")


class UpsertMismatch(InvalidArgument):
    def __init__(self, matched: int):
        self.matched = matched
        super().__init__(f"Upsert needs exactly one matching entry, found {matched}")


class ParseError(InvalidArgument):
    def __init__(self, message: str, at: int):
        self.at = at
        super().__init__(f"{message} at position {at}")

"""Statements from standard input or a prompt: python -m vecmill [--no-interactive] [SNAPSHOT]."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from vecmill.errors import EngineError
from vecmill.plans.engine import Engine


def show(result, out: Callable[[str], None] = print) -> None:
    if isinstance(result, DataFrame):
        result.show(100, truncate=80)
    else:
        out(f"error {result.code}: {result}" if isinstance(result, EngineError) else str(result))


def serve(engine: Engine, lines: Iterable[str], quiet: bool = True, out: Callable[[str], None] = print) -> None:
    """The results of each line's statements; a line that cannot be read gives its error, and the next one follows."""
    ask = lambda: None if quiet else print("vecmill> ", end="", flush=True)
    ask()
    for line in lines:
        try:
            for r in engine.query(line.strip()):
                show(r, out)
        except EngineError as e:
            show(e, out)
        ask()


def main(args: list[str]) -> None:
    paths = [a for a in args if not a.startswith("--")]
    engine = Engine(SparkSession.builder.appName("vecmill").getOrCreate())
    if paths:
        engine.read_snapshot(paths[0])
    serve(engine, sys.stdin, "--no-interactive" in args)


if __name__ == "__main__":
    main(sys.argv[1:])

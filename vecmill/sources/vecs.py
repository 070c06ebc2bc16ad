"""Files of vectors: records of a little-endian 32-bit dimension and as many 32-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def parse(data: bytes, floats: bool = True) -> np.ndarray:
    if not data:
        return np.zeros((0, 0), np.float32 if floats else np.int32)
    words = np.frombuffer(data, "<i4")
    d = int(words[0])
    if d <= 0 or len(words) % (d + 1) or (words.reshape(-1, d + 1)[:, 0] != d).any():
        raise ValueError("not a file of equally long vectors")
    body = words.reshape(-1, d + 1)[:, 1:]
    return body.view("<f4") if floats else body


def read_vecs(spark: SparkSession, path: str, floats: bool = True) -> DataFrame:
    """(file, pos, vector) of .fvecs (``floats``) or .ivecs files."""
    kind = "float" if floats else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                m = parse(content.as_py(), floats)
                for at in range(0, len(m), 4096):
                    x = np.ascontiguousarray(m[at : at + 4096])
                    vectors = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1],
                        pa.array(x.reshape(-1), pa.float32() if floats else pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(at, at + len(x))), vectors],
                        ["file", "pos", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run,
        f"file string, pos long, vector array<{kind}>")

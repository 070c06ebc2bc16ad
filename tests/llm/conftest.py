import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_prose import prose  # noqa: E402

@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, empty, null and very long texts."""
    rng, rows = random.Random(7), []
    for i in range(120):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i * 3 + 5, prose(rng, lang, rng.choice([3, 8, 40, 120, 300])), lang, f"s{i % 4}"))
    base = prose(rng, "en", 200).split()
    for k in range(12):  # near copies: a word or two apart
        words = list(base)
        for p in rng.sample(range(len(words)), k % 3):
            words[p] = f"changed{k}"
        rows.append((1000 + k, " ".join(words), "en", "hot"))
    rows.append(rows[-1])
    rows += [(2000 + k, rows[3][1], "en", "hot") for k in range(9)]
    rows += [(3000, None, None, None), (3001, "", "en", None), (3002, "", None, "s1"), (3003, "!!! ... ???", "en", "s1"), (3004, prose(rng, "fr", 6000), "fr", "s2"), (3005, "x" * 9000, "en", "s2"), (3006, "one", "en", "s3"), (3006, "one", "en", "s3")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names the operators might want for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    for name in ("id", "length", "size", "piece", "k", "h", "n", "tree", "score", "v"):
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

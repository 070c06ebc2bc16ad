import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def tables(spark, docs, corpus, tmp_path_factory):
    """documents with clashing columns, and labels under which one word is toxic."""
    sf_dir = f"file://{tmp_path_factory.mktemp('tables')}"
    bad = [(9000 + i, f"{t} slurword {t}", lang, "hot", 0) for i, (_, t, lang, *_) in enumerate(corpus[:60])]
    extra = spark.createDataFrame(bad, "doc_id long, text string, lang string, source string, n_chars long")
    for name in set(docs.columns) - set(extra.columns):
        extra = extra.withColumn(name, F.lit("clash"))
    docs.unionByName(extra).write.parquet(f"{sf_dir}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in corpus] + [(i, 1, 1) for i, *_ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    return sf_dir


def test_stages(spark, tables, corpus):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, texts = docs.columns, {(r["doc_id"], r["text"]) for r in docs.collect()}
    kept = cp.drop_toxic(spark, docs, tables).cache()
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and {i for i, *_ in corpus} <= left and len([i for i in left if i >= 9000]) <= 3
    named = cp.drop_unidentified(spark, kept, tables).cache()
    left = {r["doc_id"] for r in named.collect()}
    assert named.columns == columns and not left & {3000, 3001, 3002, 3003} and {i for i, t, *_ in corpus if t and any(c.isalpha() for c in t)} <= left
    single = cp.drop_near_duplicates(spark, named, tables).cache()
    rows = single.collect()
    left = [r["doc_id"] for r in rows]
    assert single.columns == columns and 1000 in left and not set(left) & set(range(1001, 1012)) and not set(left) & set(range(2000, 2009))
    assert left.count(3006) == 1 and {(r["doc_id"], r["text"]) for r in rows} <= texts
    mixed = cp.mix_sources(spark, single, tables).cache()
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= set(left)
    before = {r["doc_id"]: r["text"].split() for r in rows}
    for r in mixed.collect():
        words = iter(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and all(w in words for w in r["text"].split())  # in order
    packed = cp.pack_sequences(spark, mixed, tables).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}


def test_letters_stay_where_no_language_is_known(spark, docs, corpus, tables):
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    left = sorted(r["doc_id"] for r in cp.drop_unidentified(spark, unknown, tables).collect())
    assert left == sorted(i for i, t, *_ in corpus if t and any(c.isalpha() for c in t)) and left


def test_indifferent_texts_go(spark, tables, monkeypatch):
    """The stage rejects by the network's probability: all of a threshold above certainty, none of a mere guess."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 100")
    lettered = docs.where("text rlike '[a-z]'").count()
    for sure, left in ((0.0, lettered), (1.1, lettered), (1e9, 0)):
        monkeypatch.setattr(cp, "SURE", sure)
        assert cp.drop_unidentified(spark, docs, tables).count() == left
    one = docs.withColumn("lang", F.lit("en"))
    assert cp.drop_unidentified(spark, one, tables).count() == lettered  # of one language there is nothing to tell


def test_null_ids_and_repeated_rows(spark, tables):
    """Every stage takes them; what the last one packs are the tokens of the texts that the mix made."""
    from collections import Counter

    from vecmill.llm.common import load_tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 200")
    odd = docs.limit(4).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).cache()
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, tables).cache()
        assert after.columns == docs.columns and after.count() > 0, name
        if name in ("toxicity", "language"):
            assert after.where("doc_id is null").count() == 4 and after.count() == docs.count(), name
        docs = after
    tok = load_tokenizer("word_bpe_49k.json")
    want = Counter((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = Counter()
    for r in cp.pack_sequences(spark, docs, tables).collect():
        got[r["doc_id"]] += r["length"]
    sums = Counter()
    for (i, n), times in want.items():
        sums[i] += n * times
    assert got == sums


def test_run_and_nothing(spark, tables, tmp_path):
    assert cp.run(spark, tables).count() > 0
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0

"""The corpus pipeline: toxicity, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import materialize, table
from vecmill.llm.language import identify
from vecmill.llm.mixing import WORD, mix
from vecmill.llm.ngram_join import ngram_join
from vecmill.llm.packing import pack
from vecmill.llm.toxicity import score_toxicity

#: The columns that an operator passes through unread.
REST = "_vm_rest"


def _boxed(docs: DataFrame) -> DataFrame:
    """What an operator reads, and all columns but the text apart, so that none can clash with the operator's own."""
    rest = F.struct(F.lit(0).alias("_vm_none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", "lang", rest.alias(REST))


def _unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_vm_text" if c == "text" else f"{REST}.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Empty and null texts stay, as do all where no label is known. Rows that are
    equal share one fate; null ids are judged like others; an empty table stays empty.
    """
    scored = score_toxicity(_boxed(docs), table(spark, sf_dir, "labels"), extra=(REST,), keep_text=True)
    return _unboxed(scored.where("predicted = 0"), docs)


#: A text is rejected if its language's probability is below this multiple of what guessing gives. Texts of
#: one word and of words of two languages reach 1.38 times that (the least of 51,282, of four languages).
SURE = 1.1


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; what has no letter (null and empty texts too) is rejected.

    So is a text of letters on whose language the network is as good as indifferent:
    whose probability is below ``SURE`` / number of languages. Which of them it is,
    even when two come close, is no reason to drop it. Where there was no
    language to learn, or only one, all texts of letters stay. Repeated rows and
    null ids are judged like others; an empty table stays empty.
    """
    found = identify(_boxed(docs), extra=(REST,), keep_text=True)
    told = (F.col("lang_pred") != "und") & (F.col("score") * F.col("languages") >= SURE)
    nothing_known = (F.col("languages") < 2) & F.col("_vm_text").rlike(r"\p{L}")
    return _unboxed(found.where(told | nothing_known), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of rows that repeat its id and text, one."""
    kept = ngram_join(docs).where("kept").select(F.col("doc_id").alias("_vm_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_vm_id"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: for each pass over its source, a document's words that the pass takes.

    A pass that takes all words keeps the text as it is; a pass that takes some
    keeps those words, in order, separated by blanks. So a document comes up to
    three times, or not at all. n_chars, where there is such a column, follows
    the text. Documents without words are not taken.
    """
    documents, taken = mix(docs)
    cuts = taken.groupBy("sid", "from", "pass").agg(F.sort_array(F.collect_list(F.struct("skip", "take"))).alias("cuts"),
        F.sum("take").alias("words"))
    lowest, none = F.lit(-(1 << 63)), F.lit("\u0000")
    got = documents.join(cuts, ["sid", "from"]).select(F.coalesce("doc_id", lowest).alias("k"), F.col("h"),
        F.coalesce("source", none).alias("s"), "size", "words", "cuts")
    # rows equal in id, source and text stand for one another; texts are shuffled once
    keyed = docs.select(F.coalesce("doc_id", lowest).alias("k"), F.xxhash64("text").alias("h"), F.coalesce("source", none).alias("s"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = keyed.groupBy("k", "h", "s").agg(F.first("row").alias("row")).join(got, ["k", "h", "s"])
    whole = F.col("row.text")
    some = _let(F.regexp_extract_all(whole, F.lit(WORD), 0),
        lambda ws: F.array_join(F.flatten(F.transform("cuts",
            lambda c: F.slice(ws, (c["skip"] + 1).cast("int"), c["take"].cast("int")))), " "))
    text = F.when(F.col("words") == F.col("size"), whole).otherwise(some)
    done = rows.select("row", text.alias("text"))
    kinds = dict(docs.dtypes)
    fresh = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return done.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in sequences of 4096 tokens.

    A document that the mix holds more than once is packed as often; null ids
    stay null; null and empty texts are one closing id; an empty table gives no pieces.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, signatures and hashed permutations have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs

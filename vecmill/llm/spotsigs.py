"""Document fingerprints by spot signatures (operator 10). Built-in functions only.

A signature is a common word (an anchor) and the chain of the next content
words after it, common words left out. Template words around a text hold few
anchors, running prose many, so the signatures follow the content. A
document's fingerprint is its set of signatures, 32 bits each. Fingerprints
are compared by Jaccard; sets whose sizes alone rule the threshold out are
never compared, which is what partitions by set size are for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.llm.common import materialize

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their them they this to was were what when which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer es für ich im ist mit nach nicht sich sie sind so und von vor war wie wir zu zum zur "
    "al como con del el ella en entre es esta este fue ha la las lo los más me mi muy no o para pero por que se sin son su sus te tu un una y ya"
).split()
CHAIN = 3


def _hash(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(0xFFFFFFFF)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of 32-bit spot signatures of a text, as an array of longs.

    The text's start is an anchor too. Where a text holds no common word, each
    of its words is an anchor. A text without any word has one signature, its
    own hash; an empty one has none.
    """
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    after = lambda all_, k: F.substring_index(F.coalesce(F.get(all_, k), F.lit("")), "\t", -1)

    def spot(s: Column, i: Column, all_: Column) -> Column:
        """A segment's anchor and the first content words from there on; other segments hold a word at least each."""
        following = F.concat(F.substring_index(s, "\t", -1), *[after(all_, i + k) for k in range(1, chain)])
        return _hash(F.concat(F.substring_index(s, "\t", 1), F.lit("\t"), F.substring_index(following, " ", chain)))

    def of_segments(all_: Column) -> Column:
        # what stands before the first line feed is no segment
        return F.slice(F.transform(all_, lambda s, i: spot(s, i, all_)), 2, F.greatest(F.size(all_) - 1, F.lit(0)))

    def of_words(words: Column) -> Column:
        marked = F.transform(words, lambda w: F.when(w.isin(ANCHORS),
            F.concat(F.lit("\n"), w, F.lit("\t"))).otherwise(F.concat(w, F.lit(" "))))
        # of anchors in a row the last counts; what follows each anchor up to the next is a segment
        joined = F.regexp_replace(F.array_join(F.concat(F.array(F.lit("\n^\t")), marked), ""), r"\n[^\t\n]*\t(?=\n)", "")
        runs = F.transform(words, lambda w, i: _hash(F.array_join(F.slice(words, i + 1, chain + 1), " ")))
        return _let(F.split(joined, "\n"), lambda segments: F.when(F.size(segments) > 2, of_segments(segments)).otherwise(runs))

    none = F.array().cast("array<bigint>")
    chosen = _let(clean, lambda c: F.when(text == "", none).when(c == "", F.array(_hash(text))).otherwise(_let(F.split(c, " "), of_words)))
    return F.array_sort(F.array_distinct(chosen))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a nested function names it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(sigs: Column) -> Column:
    """Signatures as text: eight hexadecimal digits each, in ascending order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 where sizes alone put it below ``least``. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, h, text): the id (null: the smallest long) and a hash of the text, null texts empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"),
        text.alias("text"))


def following(keys: DataFrame, buckets: int) -> DataFrame:
    """(k, h, n, copies) with the next key (nk, nh) in descending order, the last followed by the first.

    Keys are sorted into ranges; each range finds its own successors, and its
    last key the first of the next range through a table of one row a range.
    """
    order = [F.desc("k"), F.asc("h")]
    placed = materialize(keys.repartitionByRange(buckets, *order).withColumn("bucket", F.spark_partition_id()), "ranges")
    near = placed.select("*", F.lead(F.struct("k", "h")).over(Window.partitionBy("bucket").orderBy(*order)).alias("next"))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("k").alias("o"), "h", "k")).alias("f"))  # turns the order round
    across = Window.orderBy("bucket")
    heads = firsts.select("bucket", F.coalesce(F.lead("f").over(across), F.first("f").over(across)).alias("f")).select("bucket",
        F.struct("f.k", "f.h").alias("head"))
    joined = near.join(heads, "bucket")
    return joined.select("k", "h", "n", "copies", F.coalesce("next", "head").alias("x")).select("k", "h", "n", "copies",
        F.col("x.k").alias("nk"), F.col("x.h").alias("nh"))


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_docs: int = 100_000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last third (rounded down) of a text's code points
    replaced by the first as many (or all) of the next document's, in descending
    order of ids, null last, the last followed by the first. Null texts are
    empty; rows that repeat an id follow one another by a hash of their texts;
    rows equal in both follow one another too. One document alone is its own
    next. An empty table gives an empty result; other columns are ignored.

    Texts are shuffled once, by key; of the next document only as many
    characters as are needed travel, with its signatures.
    """
    keyed = _keyed(docs, id_col, text_col)
    keys = keyed.groupBy("k", "h").agg(F.first(F.length("text")).alias("n"), F.count("*").alias("copies"))
    order = following(keys, 8 + docs.count() // bucket_docs)
    base = keyed.select("k", "h", "text", signatures(F.col("text")).alias("sigs"))
    base = base.groupBy("k", "h").agg(F.first("text").alias("text"), F.first("sigs").alias("sigs"))
    wanted = order.select(F.col("k").alias("ck"), F.col("h").alias("ch"), "n", "copies", F.col("nk").alias("k"), F.col("nh").alias("h"))
    given = base.join(wanted, ["k", "h"]).select(
        F.col("ck").alias("k"), F.col("ch").alias("h"), "copies",
            F.substring(F.col("text"), F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("tail"), F.col("sigs").alias("next_sigs")
    )
    both = base.join(given, ["k", "h"])
    n, own = F.length("text"), F.col("text")
    cut = F.floor(n / 3).cast("int")
    head = F.substring(own, F.lit(1), n - cut)
    # of rows that are equal, all but the last are followed by their equals
    turned = both.select("k", "sigs", n.cast("long").alias("n_chars"),
        F.explode(F.when(F.col("copies") == 1, F.array(_follow(F.concat(head, "tail"), F.col("next_sigs")))).otherwise(
        F.concat(F.array_repeat(_follow(F.concat(head, F.substring(own, F.lit(1), cut)), F.col("sigs")),
            F.col("copies").cast("int") - 1), F.array(_follow(F.concat(head, "tail"), F.col("next_sigs"))))
    )).alias("e"))
    done = turned.select("k", "n_chars", F.sha2(F.col("e.edited"), 256).alias("edited_sha256"), "sigs",
        signatures(F.col("e.edited")).alias("edited_sigs"), F.col("e.next_sigs").alias("next_sigs"))
    return done.select(
        F.when(F.col("k") != F.lit(-(1 << 63)), F.col("k")).alias(id_col), "n_chars", "edited_sha256",
            fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
            likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def _follow(edited: Column, sigs: Column) -> Column:
    return F.struct(edited.alias("edited"), sigs.alias("next_sigs"))


def similar_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of rows (id, sigs) with a Jaccard of at least ``least``, a < b.

    Sets are partitioned by size into bands, each ``1 / least`` times as wide
    as the one before, so partners lie in the same band or the next. Within
    bands, pairs meet on one of the rarest signatures of a set: if two sets of
    n are that alike, the first n - ceil(least * n) + 1 of each in the order of
    rarity share one. Equal sets should be folded into one id beforehand.
    """
    sized = prints.select("id", "sigs", F.size("sigs").alias("n")).where("n > 0")
    rows = sized.select("id", F.explode("sigs").alias("s"), "n")
    rarity = rows.groupBy("s").agg(F.count("*").alias("f"))
    ranked = rows.join(rarity, "s").where("f > 1").select("id", "s", "n",
        F.row_number().over(Window.partitionBy("id").orderBy("f", "s")).alias("r"), F.count("*").over(Window.partitionBy("id")).alias("m"))
    # signatures of one set alone come first of all and match nothing
    probes = ranked.where(F.col("r") + F.col("n") - F.col("m") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    band = F.floor(F.log(F.col("n")) / -math.log(least) + 1e-9).cast("int")
    probes = probes.select("id", "s", "n", band.alias("band"))
    left = probes.select(F.col("id").alias("a"), "s", F.col("n").alias("na"),
        F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("own"))
    right = probes.select(F.col("id").alias("b"), "s", F.col("n").alias("nb"), "band")
    pairs = left.join(right, ["s", "band"]).where(((F.col("own") < F.col("band")) | (F.col("a") < F.col("b"))) & (F.least("na",
        "nb") >= least * F.greatest("na", "nb")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    sets = sized.select("id", "sigs")
    met = pairs.join(sets.withColumnsRenamed({"id": "a", "sigs": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "sigs": "sb"}), "b")
    return met.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)

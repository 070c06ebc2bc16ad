"""Mixing sources to target weights (operator 9). Built-in functions only.

The words of each source form one stream, cut into blocks of fixed length. The
mix is laid out as output shards of so many slots; for every slot a source is
drawn, so a shard's source counts are multinomial. A source's slots are
numbered through the shards; slot numbers beyond its quota fall out and what
it lacks goes to balancing shards, so totals meet the targets to within a
block. Numbers map to blocks through a pseudorandom permutation of the source's
block indexes (one for each pass), and slots join blocks by index. As a
permutation meets every index once, no block comes up more often than the
target exceeds the source, rounded up: three times at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: More sources than these are refused, never left out: their figures go to the driver and to every task.
MOST_SOURCES = 10_000
SLOTS_A_TASK = 50_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    number: int


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> list[Source]:
    """Targets of sources by code point (null last), weights repeating.

    They share the sum of all sizes; none is above ``most`` times its size, the
    excess being shared again by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, goal = float(sum(sizes.values())), list(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not above:
            goal |= {s: share * weight[s] for s in open_}
            break
        goal |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in goal]
    return [Source(s, sizes[s], float(goal[s]), i) for i, s in enumerate(names)]


def permuted(index: Column, size: Column, *keys: Column, rounds: int = 32) -> Column:
    """A pseudorandom permutation of 0..size-1, keyed: swap-or-not rounds, so it fits any size.

    Each round pairs x with key - x and a bit of the pair's hash says whether
    to swap them; as both members see the same bit, a round is a bijection.
    """

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("key"), r, *keys), size) - x, size)
        return F.when(F.pmod(F.xxhash64(F.lit("bit"), r, F.greatest(x, partner), *keys), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)


def laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[Column],
    slice_docs: int = 1000) -> tuple[DataFrame, list[Source]]:
    """Rows (doc_id, size, sid, from, *keep): where each document's words lie in its source's stream.

    Documents of a source are dealt by hash into slices of about
    ``slice_docs``; running sums within slices and over the slices' totals give
    the places, so a source with most documents is spread like the others.
    """
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD), 0)).cast("long")
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
        F.xxhash64(text_col).alias("h"), *keep), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("size"),
        F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()  # a row for each source
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    sources = targets({r["source"]: r["size"] for r in totals})
    number = {s.name: s.number for s in sources}
    spread = docs.sparkSession.createDataFrame([(r["source"], number[r["source"]], 1 + r["n"] // slice_docs) for r in totals],
        "name string, sid int, slices long")
    sliced = slim.join(F.broadcast(spread), F.col("source").eqNullSafe(F.col("name"))).withColumn("slice",
        F.pmod(F.xxhash64("doc_id", "h"), "slices")).drop("name", "slices")
    before = sliced.groupBy("sid", "slice").agg(F.sum("size").alias("words"))
    before = before.select("sid", "slice",
        (F.sum("words").over(Window.partitionBy("sid").orderBy("slice")) - F.col("words")).alias("before"))
    within = Window.partitionBy("sid", "slice").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, ["sid", "slice"])
    return placed.withColumn("from", F.col("before") + F.col("within")).drop("within", "before", "slice"), sources


def draw_slots(spark, sources: list[Source], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, shard, slot, number, pass, block, words): every slot of the mix.

    ``number`` counts a source's slots; pass and block follow from it. Each
    full pass takes a whole source; the last, partial pass takes what the target
    still lacks, so its last block may be cut short.
    """
    plan = []
    for s in sources:
        blocks = -(-s.size // block_words)
        passes = int(s.target // s.size) if s.size else 0
        rest = round(s.target - passes * s.size)
        plan.append((s.number, s.size, blocks, passes, rest, passes * blocks + -(-rest // block_words)))
    slots = sum(p[-1] for p in plan)
    if not slots:
        return spark.createDataFrame([], "sid int, shard long, slot int, number long, pass int, block long, words long")
    edges, total = [], 0
    for p in plan[:-1]:
        total += p[-1]
        edges.append(total / slots)
    shards = slots // shard_slots
    facts = spark.createDataFrame(plan, "sid int, size long, blocks long, passes int, rest long, quota long")
    # a uniform number for each slot picks the source by the cumulative shares
    u = (F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(1 << 53)) / float(1 << 53)).alias("u")
    picked = F.size(F.filter(F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>"), lambda e: e <= F.col("u")))
    cells = spark.range(shards).select(F.col("id").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("slot")).select("shard", "slot", u)
    drawn = cells.select("shard", "slot", picked.alias("sid"))
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))
    # counts run through the shards in groups, so no window holds one row for every shard
    counts = counts.withColumn("band", F.floor(F.col("shard") / 4096))
    bands = counts.groupBy("sid", "band").agg(F.sum("n").alias("m"))
    bands = bands.select("sid", "band", (F.sum("m").over(Window.partitionBy("sid").orderBy("band")) - F.col("m")).alias("ahead"))
    inside = F.sum("n").over(Window.partitionBy("sid", "band").orderBy("shard")) - F.col("n")
    counts = counts.withColumn("inside", inside).join(bands, ["sid", "band"])
    starts = counts.select("shard", "sid", "n", (F.col("ahead") + F.col("inside")).alias("first"))
    # few rows here become many slots: dealt by their number, not by their present size
    starts = starts.repartition(1 + slots // SLOTS_A_TASK, "shard", "sid")
    numbered = starts.select("sid", "shard", "first",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("sid", "shard",
            (F.col("first") + F.col("k")).alias("number"))
    numbered = numbered.join(F.broadcast(facts.select("sid", "quota")), "sid").where("number < quota").drop("quota")
    # what the draws left over goes to balancing shards
    lack = facts.join(starts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").select("sid",
        F.coalesce("n", F.lit(0)).alias("n"), "quota").where("n < quota")
    lack = lack.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("n") - 1) / shard_slots))))
    begin = F.col("n") + F.col("g") * shard_slots
    lack = lack.select("sid", F.explode(F.sequence(begin, F.least(begin + shard_slots, "quota") - 1)).alias("number"))
    balancing = lack.select("sid", (shards + F.pmod(F.xxhash64(F.lit(seed), "sid", "number"), F.lit(1 + shards // 64))).alias("shard"),
        "number")
    every = numbered.unionByName(balancing).join(F.broadcast(facts), "sid")
    every = every.withColumn("pass", F.floor(F.col("number") / F.col("blocks")).cast("int")).withColumn("k", F.pmod("number", "blocks"))
    every = every.withColumn("block", permuted(F.col("k"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("pass")))
    words = F.when(F.col("pass") < F.col("passes"),
        F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - F.col("k") * block_words))
    return every.select("sid", "shard", "number", "pass", "block", words.cast("long").alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64,
    shard_slots: int = 4096, seed: int = 7, keep: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, taken): the laid-out documents with their source's figures, and the mix.

    documents: doc_id, size, h, source, sid, from, source_size, target, *keep.
    taken: sid, from (together one document), shard, number, pass, skip, take - the
    words [skip, skip + take) of that document stand in that slot of that shard.

    Null texts have no words; empty documents, and sources of nothing but them,
    are taken 0 words. Null sources are one source, the last. Repeated rows are
    documents of their own. An empty table gives an empty mix. Sources are
    numbered on the driver, one row each, and more than ``MOST_SOURCES`` are an
    error; documents never go there.
    """
    spark = docs.sparkSession
    placed, sources = laid_out(docs, id_col, text_col, source_col, list(keep))
    placed = materialize(placed, "placed")
    slots = draw_slots(spark, sources, block_words, shard_slots, seed)
    full = placed.where("size > 0").select(
        "sid", "from", "size", F.explode(F.sequence(F.floor(F.col("from") / block_words),
            F.floor((F.col("from") + F.col("size") - 1) / block_words))).alias("block")
    )
    head = F.greatest(F.col("from"), F.col("block") * block_words)
    tail = F.least(F.col("from") + F.col("size"), F.col("block") * block_words + F.col("words"))
    joined = full.join(slots, ["sid", "block"]).where(tail > head)
    taken = joined.select("sid", "from", "shard", "number", "pass", (head - F.col("from")).alias("skip"), (tail - head).alias("take"))
    facts = spark.createDataFrame([(s.number, s.size, s.target) for s in sources], "sid int, source_size long, target double")
    return placed.join(F.broadcast(facts), "sid"), taken


def taken_words(documents: DataFrame, taken: DataFrame) -> DataFrame:
    """documents with ``taken``: how many words of each the mix takes, repeats counted."""
    sums = taken.groupBy("sid", "from").agg(F.sum("take").alias("taken"))
    some = documents.where("size > 0").join(sums, ["sid", "from"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return some.unionByName(documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")))

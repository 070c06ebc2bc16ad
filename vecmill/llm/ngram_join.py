"""N-gram Jaccard join by a MinHash LSH forest (operator 2).

Texts become sets of word shingles, as 32-bit hashes; equal sets are one class.
Each class has a signature of MinHash values, read as ``trees`` sequences of
``depth`` values. Each tree's sequences are sorted, so that those with a common
prefix stand together: a trie, whose nodes are named by their smallest member
and kept as edges with the depth at which they meet. Signatures that meet are
joined into clusters, and all pairs within a cluster are verified exactly (but
for the hashes), in blocks, on the shingle sets. Prefixes are shortened until a pair of the least likeness
meets with the chance asked for, and then for as long as one value less still
brings new links: links are compared with those whose members already shared a
cluster at the longer prefix, each class counting once however many it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.blocks import block_pairs, by_unit, joining_edges
from vecmill.llm.common import connected_components, in_batches, materialize

NO_WORD = r"[^\p{L}\p{N}_]+"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 1 << 18  # sets that a task remembers to have signed; what it forgets is signed again, which does no harm
TRIE = ["level", "a", "b", "tree", "signature", "part", "place"]


class Shingler:
    """Sorted sets of 32-bit shingle hashes of texts. Words are hashed once a batch of texts."""

    def __init__(self, words: int = 5):
        self.words = words

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text all runs of ``words`` words, lower-case; the whole text if it has fewer; nothing without a word (or for null)."""
        split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), NO_WORD)
        owner, tokens = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), split.flatten()
        real = pc.greater(pc.binary_length(tokens), 0)  # what stands before a leading sign is empty
        owner, tokens = owner[real.to_numpy(zero_copy_only=False)], tokens.filter(real).dictionary_encode()
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in tokens.dictionary.to_pylist()], np.uint64)
        codes = hashed[tokens.indices.to_numpy()] if len(hashed) else hashed
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        whole, begin, out = self._runs(codes, self.words, 0), 0, []
        for end in ends.tolist():
            n = end - begin
            if n >= self.words:
                out.append(np.unique(whole[begin : end - self.words + 1]))
            else:
                out.append(self._runs(codes[begin:end], n, n) if n else np.zeros(0, np.uint32))
            begin = end
        return out

    def set_of(self, text: str) -> np.ndarray:
        return self.sets(pa.array([text], pa.string()))[0]

    @staticmethod
    def _runs(codes: np.ndarray, k: int, seed: int) -> np.ndarray:
        n = max(0, len(codes) - k + 1)
        h = np.full(n, seed, np.uint64)
        for i in range(k):
            h = (h ^ codes[i : i + n]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(32)).astype(np.uint32)


def hashers(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def min_hashes(items: np.ndarray, mult: np.ndarray, add: np.ndarray, step: int = 2048) -> np.ndarray:
    """The upper 16 bits of the smallest image of the set under each hash."""
    # hashes that are linear in the item need it mixed well first
    x = items * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), step):
        part = np.multiply.outer(mult, x[at : at + step])
        part += add[:, None]
        np.minimum(low, part.min(1), out=low)
    return (low >> np.uint32(16)).astype(">u2")


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, trees: int, depth: int) -> DataFrame:
    """(id, digest, n, signature, shingles) of every row; the last three are null or 0 for a text without a word."""
    mult, add = hashers(trees * depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signed = Shingler(words), set()
        for b in batches:
            rows = []
            for s in shingler.sets(b.column("text")):
                if not len(s):
                    rows.append((None, 0, None, None))
                    continue
                digest, signature = xxhash.xxh128_digest(s.tobytes()), None
                if digest not in signed:
                    if len(signed) >= REMEMBERED:
                        signed.clear()
                    signed.add(digest)
                    signature = min_hashes(s, mult, add).tobytes()
                rows.append((digest, len(s), signature, s.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["id", "digest", "n", "signature", "shingles"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(slim, run, "id long, digest binary, n long, signature binary, shingles binary")


def trie_edges(batches: Iterator[pa.RecordBatch], part: int, depth: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """The prefix tries of rows (tree, signature, node) that come sorted: (level, a, b, tree, signature, part, place).

    Runs of rows that share a prefix of ``level`` values are a trie's nodes at
    that depth; each is named by its smallest member, and an edge leads from
    every node to each child of another name, down to single rows. So members
    of a node hang together over the edges of its level and above, and a row adds one edge at most.
    What stands next to each other in two batches is joined by an edge of its own;
    the first and the last row of all (place 0, 1) are given for the same purpose.
    """

    def values(b: pa.RecordBatch) -> np.ndarray:
        column = b.column("signature")
        at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        return np.frombuffer(column.buffers()[2], ">u2")[at[0] // 2 : at[-1] // 2].reshape(len(column),
            depth) if len(column) else np.zeros((0, depth), ">u2")

    def shared(x: np.ndarray, y: np.ndarray, same_tree: np.ndarray) -> np.ndarray:
        return np.cumprod(x == y, 1).sum(1) * same_tree

    def batch(level, a, b) -> pa.RecordBatch:
        n = len(a)
        empty = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *empty], TRIE)

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        v, tree, node = values(b), b.column("tree").to_numpy(), b.column("node").to_numpy()
        if last is None:
            yield _edge_of_part(b, 0, part, 0)
        else:
            level = shared(last[0], v[:1], last[1] == tree[:1])
            if level[0] >= shortest and last[2][0] != node[0]:
                yield batch(level, last[2], node[:1])
        meet = np.concatenate([[-1], shared(v[1:], v[:-1], tree[1:] == tree[:-1])])
        begins, names = np.arange(len(node)), node
        for level in range(depth, shortest - 1, -1):
            # runs of this level are runs of those before it
            new = np.flatnonzero(meet[begins] < level)
            parent = np.minimum.reduceat(names, new)
            of = np.repeat(parent, np.diff(np.append(new, len(names))))
            child = of != names
            if child.any():
                yield batch(np.full(child.sum(), level), of[child], names[child])
            begins, names = begins[new], parent
        last = v[-1:], tree[-1:], node[-1:], b.slice(b.num_rows - 1)
    if last is not None:
        yield _edge_of_part(last[3], 0, part, 1)


def _edge_of_part(b: pa.RecordBatch, at: int, part: int, place: int) -> pa.RecordBatch:
    b = b.slice(at, 1)
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), b.column("node"), b.column("node"), b.column("tree"),
        b.column("signature"), pa.array([part], pa.int32()), pa.array([place], pa.int32())], TRIE)


def lsh_forest(signed: DataFrame, trees: int, depth: int, shortest: int) -> DataFrame:
    """(level, a, b): the edges of the tries of all trees; see ``trie_edges``.

    Signatures are sorted by tree over all partitions, ties by node, so a
    prefix that a third of them share is many partitions. What meets at the
    partitions' ends, two rows each, is joined on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trie_edges(batches, TaskContext.get().partitionId(), depth, shortest)

    cut = F.array(*[F.struct(F.lit(t).alias("tree"),
        F.substring("signature", 2 * depth * t + 1, 2 * depth).alias("signature")) for t in range(trees)])
    rows = signed.select("node", F.explode(cut).alias("s")).select("s.tree", "s.signature", "node")
    dealt = rows.repartitionByRange("tree", "signature", "node").sortWithinPartitions("tree", "signature", "node")
    found = materialize(in_batches(dealt, run, "level int, a long, b long, tree int, signature binary, part int, place int"), "tries")
    ends = sorted(found.where("place is not null").collect(), key=lambda r: (r["part"], r["place"]))
    across = []
    for x, y in zip(ends, ends[1:], strict=False):
        if (x["place"], y["place"]) == (1, 0) and x["tree"] == y["tree"]:
            s, t = (np.frombuffer(e["signature"], ">u2") for e in (x, y))
            level = int(np.cumprod(s == t).sum())
            if level >= shortest and x["a"] != y["a"]:
                across.append((level, x["a"], y["a"]))
    inner = found.where("place is null").select("level", "a", "b")
    if not across:
        return inner
    return inner.unionAll(signed.sparkSession.createDataFrame(across, "level int, a long, b long"))


def common_counts(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many items each two different sets have in common; the diagonal means nothing."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[item] > 1  # items of one set alone add nothing
    owner, item = owner[shared], item[shared]
    number = np.cumsum(np.bincount(item, minlength=len(times)) > 0) - 1
    item = number[item] if len(item) else item
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    out, top = np.zeros((n, n), np.float64), int(item[-1]) + 1 if len(item) else 0
    for at in range(0, top, columns):
        a, b = np.searchsorted(item, [at, at + columns])
        m = np.zeros((n, min(columns, top - at)), np.float32)
        m[owner[a:b], item[a:b] - at] = 1
        out += m @ m.T
    return out


def verify(least: float):
    """Work on a unit of block pairs: for each member its links, how many classes they lead to, how many of those the longer prefix found, and an edge or null."""

    def work(t: pa.Table) -> dict[str, np.ndarray | pa.Array]:
        # rows that repeat id and set come once for each of them
        once = list({(i, s): n for n, (i,
            s) in enumerate(zip(t.column("id").to_pylist(), t.column("shingles").to_pylist(), strict=True))}.values())
        t = t.take(once)
        ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
        weight = t.column("weight").to_numpy().astype(np.float64)
        sets = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("shingles")]
        sizes = np.array([len(s) for s in sets], np.float64)
        common = common_counts(sets)
        linked = common / (sizes[:, None] + sizes[None, :] - common) >= least
        np.fill_diagonal(linked, False)
        parent = joining_edges(linked, own)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        if i != j:  # pairs within a block are another unit's
            linked &= own[:, None] != own[None, :]
        was = t.column("was").to_numpy()
        before = linked & (was[:, None] == was[None, :])
        keep = linked.any(1)
        up = parent[keep]
        return {"id": ids[keep], "parent": np.where(up < 0, ids[keep], ids[up]), "links": (linked @ weight)[keep].astype(np.int64),
            "met": linked.sum(1)[keep].astype(np.int64), "before": before.sum(1)[keep].astype(np.int64)}

    return work


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, trees: int = 32,
        depth: int = 8, shortest: int = 4, recall: float = 0.999, block: int = 192, report: dict | None = None
) -> DataFrame:
    """(id, class_id, n_links, component_id, kept) for every row.

    class_id: the smallest id with the same shingle set. n_links: how many
    other documents (copies included) are as alike as ``least``. component_id:
    the smallest id reachable over links; kept: whether the row has that id.

    A text of fewer words than a shingle is one shingle; a text without any
    word (null and empty ones too) links with nothing and is a class of its
    own. Rows that repeat an id are one document: they are linked, each counts
    as a copy, and all are kept or none. Rows with a null id take part under
    the smallest long and come back with null ids. An empty table gives an
    empty result; other columns are ignored.

    ``recall`` is asked of the chance that a pair of likeness ``least`` meets,
    and of the mean share, over linked classes, of their links that the prefix
    one value longer finds too; the links of the shorter one are the result. If
    ``shortest`` is reached before that, an error is raised. ``report``, if
    given, gets the prefix's ``level``, its ``chance`` and that share as ``found_before``.
    """
    lowest = F.lit(-(1 << 63))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(sketch(keyed, "id", "text", words, trees, depth), "sketches")
    # candidates are found among half digests, copies combined before each shuffle; a clash of halves only adds a candidate
    half = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    classes = sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes.select("digest", "rep", "weight", half.alias("node")), "classes")
    signed = sketches.where("signature is not null").select(half.alias("node"), "signature")

    forest_edges = lsh_forest(signed, trees, depth, min(shortest, depth))

    def clustered(level: int) -> DataFrame:
        edges = forest_edges.where(F.col("level") >= level).select("a", "b")
        return connected_components(edges, "clusters").withColumnsRenamed({"id": "node", "component": "cluster"})

    chance = lambda level: 1 - (1 - least**level) ** trees
    level = depth - 1
    while level > shortest and chance(level) < recall:
        level -= 1
    level = max(level, min(shortest, depth))
    longer = clustered(min(depth, level + 1))
    while True:
        clusters = clustered(level) if level < depth else longer
        # a node in no cluster of the longer prefix is one by itself
        was = F.coalesce("was", "node").alias("was")
        placed = clusters.join(longer.withColumnRenamed("cluster", "was"), "node", "left").select("node", "cluster", was)
        members = materialize(placed.join(classes, "node").select("cluster", F.col("rep").alias("id"), "digest", "weight", "was"),
            "members")
        units = block_pairs(members.select("cluster", "id"), ["cluster"], block).join(members, ["cluster", "id"])
        # sets are the large side at every size, so they are merged, never shipped
        sets = sketches.select("id", "digest", "shingles").hint("merge")
        units = units.join(sets, ["id", "digest"]).select("cluster", "i", "j", "id", "own", "weight", "was", "shingles")
        found = materialize(by_unit(units, ["cluster", "i", "j"], verify(least),
            "id long, parent long, links long, met long, before long"), "links")
        seen = found.groupBy("id").agg((F.sum("before") / F.sum("met")).alias("share")).agg(F.avg("share")).first()[0]
        enough = chance(level) >= recall and (seen is None or seen >= recall)
        if level <= shortest or enough:
            break
        longer, level = clusters, level - 1
    if report is not None:
        report |= {"level": level, "chance": chance(level), "found_before": seen}
    if not enough:
        raise RuntimeError(f"prefixes of {level} values are the shortest allowed: chance {chance(level):.4f}, links found before {seen}, {recall} is asked for")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("id <> parent").select(F.col("id").alias("a"), F.col("parent").alias("b")), "groups")
    known = classes.drop("node").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"),
        "rep", "left")
    rows = sketches.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "rep", "id")
    back = lambda c: F.when(c != lowest, c)
    return rows.select(
        back(F.col("id")).alias(id_col), back(F.coalesce("rep", "id")).alias("class_id"),
            F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).alias("n_links"),
        back(component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )

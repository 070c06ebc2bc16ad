"""Best-fit packing by exact-complement hashing (operator 8).

Documents become token ids (a closing id added), cut into pieces only where
longer than a sequence. The plan of which lengths share a sequence depends on
the counts per length alone - at most ``capacity`` numbers, whatever the
corpus - so it is made once on the driver. Pieces then find their place by
their rank within their length, which is counted in salted slices.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecmill.llm.common import in_batches, load_tokenizer, materialize

def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class WordMemo:
    """Ids of texts, put together from the ids of their words.

    ASCII white space separates pre-tokens in every case and special strings hold
    none, so the ids of a text are those of its words one after another; words
    repeat, so each is looked at once a batch. Latin words that end in such signs as
    full stops are two pre-tokens, put together from both; their letters alone,
    in lower case, are encoded many at a time, which ids that end a word take
    apart again. Words and ids lie in Arrow and numpy arrays, not in Python objects.

    What was encoded stays, up to ``limit`` strings of at most ``longest``
    characters (some 30 bytes each); beyond that only the present batch's stay.
    """

    #: Letters that neither lower-casing nor composition turns into anything but one letter, then signs.
    SIMPLE = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<signs>[.,!?;:$&%*#|]*)$"

    def __init__(self, tokenizer, limit: int = 400_000, longest: int = 24):
        self.tokenizer, self.limit, self.longest = tokenizer, limit, longest
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.sizes, self.values = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word is one pre-token, so as many ids end a word as there are words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return (ids, sizes) if len(sizes) == len(words) else self._encode(words)

    def _ids_of(self, parts: pa.Array, letters: np.ndarray, most: float | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many of each part) of distinct strings; ``letters`` tells which are letters alone. None if more than ``most`` characters are new."""
        at = pc.index_in(parts, value_set=self.known)
        seen = np.asarray(at.is_valid())
        if most is not None and pc.utf8_length(parts).to_numpy()[~seen].sum() > most:
            return None
        at = pc.fill_null(at, 0).to_numpy()
        begins = _offsets(self.sizes)[:-1]
        ids, sizes = [self.values[_spans(begins[at[seen]], self.sizes[at[seen]])]], [self.sizes[at[seen]]]
        order = [np.flatnonzero(seen)]
        for which, encode in ((~seen & letters, self._encode_letters), (~seen & ~letters, self._encode)):
            if which.any():
                own, n = encode(parts.filter(pa.array(which)).to_pylist())
                ids.append(own)
                sizes.append(n)
                order.append(np.flatnonzero(which))
        ids, sizes, order = np.concatenate(ids), np.concatenate(sizes), np.concatenate(order)
        back = np.argsort(order, kind="stable")
        ids, sizes = ids[_spans(_offsets(sizes)[:-1][back], sizes[back])], sizes[back]
        self._keep(parts, ids, sizes, seen)
        return ids, sizes

    def _keep(self, parts: pa.Array, ids: np.ndarray, sizes: np.ndarray, seen: np.ndarray) -> None:
        short = pc.utf8_length(parts).to_numpy() <= self.longest
        fresh = short & ~seen
        if len(self.known) + fresh.sum() > self.limit:
            self.forget()
            fresh = short & (np.cumsum(short) <= self.limit)
        self.known = pa.concat_arrays([self.known, parts.filter(pa.array(fresh))])
        self.values = np.concatenate([self.values, ids[_spans(_offsets(sizes)[:-1][fresh], sizes[fresh])]])
        self.sizes = np.concatenate([self.sizes, sizes[fresh]])

    def _of_words(self, words: pa.Array, most: float | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many of each word) of distinct words. None if more than ``most`` characters of them are new."""
        cut = pc.extract_regex(words, self.SIMPLE)
        plain = np.asarray(cut.is_valid())
        cut = cut.filter(pa.array(plain))
        letters, signs = pc.utf8_lower(cut.field("letters")), cut.field("signs")
        others = words.filter(pa.array(~plain))
        # distinct letters first, then all else; a word is one or two of these
        first = letters.dictionary_encode()
        rest = pa.concat_arrays([signs, others]).dictionary_encode()
        n = len(first.dictionary)
        got = self._ids_of(pa.concat_arrays([first.dictionary, rest.dictionary]), np.arange(n + len(rest.dictionary)) < n, most)
        if got is None:
            return None
        ids, sizes = got
        rest = rest.indices.to_numpy() + n
        one, two = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        one[plain], two[plain], one[~plain] = first.indices.to_numpy(), rest[: len(signs)], rest[len(signs) :]
        pairs = np.stack([one, two], 1).reshape(-1)
        begins = _offsets(sizes)[:-1]
        pair_sizes = np.where(pairs >= 0, sizes[pairs], 0) if len(pairs) else np.zeros(0, np.int64)
        return ids[_spans(begins[pairs], pair_sizes)], pair_sizes.reshape(-1, 2).sum(1)

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(the distinct words, the texts' words as numbers of these, where each text's begin and the last one's end)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        return words.dictionary.cast(pa.string()), words.indices.to_numpy(), _offsets(pc.list_value_length(split).to_numpy())

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin and the last one's end); null texts have none."""
        words, at, begins = self._split(texts)
        ids, sizes = self._of_words(words)
        counts = sizes[at]
        return ids[_spans(_offsets(sizes)[:-1][at], counts)], _offsets(counts)[begins]

    def counts_of(self, texts: pa.Array, most: float = 0.5) -> np.ndarray | None:
        """How many ids each text has; null texts have none. None if new words make up more than ``most`` of
        the characters: words that hardly repeat are sooner encoded in their texts."""
        words, at, begins = self._split(texts)
        got = self._of_words(words, most * (pc.sum(pc.utf8_length(texts)).as_py() or 0))
        return None if got is None else np.diff(_offsets(got[1][at])[begins])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, at = self.ids_of(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:], strict=False)]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, closing_id: int, id_col: str = "doc_id", text_col: str = "text",
    batch_chars: int = 1 << 22) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(load_tokenizer(tokenizer))  # for this task alone, so its memory ends with the task
        closing = closing_id.to_bytes(4, "little")
        for b in batches:
            texts, at = b.column("text"), 0
            chars = _offsets(pc.fill_null(pc.utf8_length(texts), 0).to_numpy() + 1)
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(chars, chars[at] + batch_chars, "right")) - 1)
                ids, begins = memo.ids_of(texts.slice(at, end - at))
                ids, rows, which = ids.astype("<u4", copy=False), [], []
                for i, (x, y) in enumerate(zip(begins.tolist(), begins[1:].tolist(), strict=False), at):
                    own = ids[x:y].tobytes() + closing
                    n = y - x + 1
                    for p, s in enumerate(range(0, n, capacity)):
                        which.append(i)
                        rows.append((p, s, min(capacity, n - s), zlib.crc32(own[4 * s : 4 * (s + capacity)])))
                at = end
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(which, pa.int64())),
                        pa.array(cols[0], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return in_batches(slim, run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Complements:
    """Sums of one, two and three available lengths, found by bit sets of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.counts = capacity, Counter(counts)
        self.bits = sum(1 << n for n in counts)
        self.mirror = sum(1 << (capacity - n) for n in counts)

    def use(self, lengths: Counter, times: int) -> None:
        for n, k in lengths.items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                self.bits &= ~(1 << n)
                self.mirror &= ~(1 << (self.capacity - n))

    def largest(self, gap: int) -> int:
        """The largest available length up to the gap, 0 if there is none."""
        return max(0, (self.bits & ((1 << (gap + 1)) - 1)).bit_length() - 1)

    def _free(self, used: Counter, *more: int) -> bool:
        need = Counter(more)
        return all(self.counts[n] - used[n] >= k for n, k in need.items())

    def pair(self, gap: int, used: Counter, *with_: int) -> tuple[int, ...]:
        # lengths a with gap - a available too: a set of bits and its mirror image
        both = self.bits & (self.mirror >> (self.capacity - gap)) & ((1 << gap) - 1)
        while both:
            a = both.bit_length() - 1
            if 2 * a < gap:
                return ()
            if self._free(used, a, gap - a, *with_):
                return (*with_, a, gap - a)
            both ^= 1 << a
        return ()

    def exact(self, gap: int, used: Counter) -> tuple[int, ...]:
        if self.counts[gap] - used[gap] > 0:
            return (gap,)
        if found := self.pair(gap, used):
            return found
        rest = self.bits & ((1 << gap) - 1)
        while rest:
            a = rest.bit_length() - 1
            if 3 * a < gap:
                return ()
            if found := self.pair(gap - a, used, a):
                return found
            rest ^= 1 << a
        return ()


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), from the counts per length.

    Starts each sequence with the longest piece left; fills its gap exactly
    with one, two or three pieces where availability allows, else places the
    piece that fits best and tries the smaller gap. A pattern is repeated as
    often as its lengths last, so the number of steps depends on the number of
    lengths, not of pieces.
    """
    left = Complements({n: c for n, c in counts.items() if c > 0}, capacity)
    plan = []
    while left.bits:
        pattern = [left.bits.bit_length() - 1]
        used, gap = Counter(pattern), capacity - pattern[0]
        while gap:
            found = left.exact(gap, used)
            if not found:
                fit = left.largest(gap)
                while fit and left.counts[fit] - used[fit] <= 0:
                    fit = left.largest(fit - 1)
                if not fit:
                    break
                found = (fit,)
            pattern += found
            used.update(found)
            gap -= sum(found)
        times = min(left.counts[n] // k for n, k in used.items())
        left.use(used, times)
        plan.append((tuple(pattern), times))
    return plan


def placements(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), by rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            rows.setdefault(n, []).append((taken[n], first, offset))
            taken[n] += times
            offset += n
        first += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, closing_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", slice_rows: int = 500) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    A null or empty text is one piece that holds the closing id alone. Repeated
    rows are packed each for itself; equal rows are interchangeable. An empty
    table gives an empty result; other columns are ignored. The pieces (no ids)
    are written once to the shared folder, so no text is encoded twice and a
    lost executor changes no rank.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, closing_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(placements(plan_sequences(counts, capacity), capacity))
    # slices of a length hold about slice_rows pieces, so a length that a third of all pieces share is spread
    slices = spark.createDataFrame([(n, 1 + c // slice_rows) for n, c in counts.items()], "length long, slices long")
    salted = pieces.join(F.broadcast(slices), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "slices"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32",
        (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = places.value[int(length[part[0]])]
                    at = np.searchsorted(rows[:, 0], rank[part], "right") - 1
                    seq[part] = rows[at, 1] + rank[part] - rows[at, 0]
                    off[part] = rows[at, 2]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)],
                [*names, "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    out = in_batches(ranked, place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)

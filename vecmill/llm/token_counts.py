"""Token counts with overlap resynchronisation (operator 1).

Ordinary texts are encoded in batches. Where the tokenizer consists of parts by which
white space bounds pre-tokens (``words_stand_alone``), a batch's different words are encoded once
each and their counts added up; whole texts are encoded with other tokenizers, and where words hardly repeat.
A huge text is encoded in overlapping chunks with offsets, and neighbouring chunks are
spliced at a boundary that is proven to be one of the whole text:

* the pre-tokenizer scans left to right, so once a pre-token starts at some
  offset, everything after it depends on the rest of the text alone;
* by induction the left chunk's pre-token starts are right up to a guard before
  its end (longer than any special string), so an offset at which *both* chunks
  start a pre-token starts one in the whole text;
* normalisation composes nothing across the boundary if the character there is
  no combining mark and no trailing Hangul jamo, and the pre-token's start is
  that character's start if it stays one character.

When no such offset lies in the overlap, the overlap doubles; when it would
reach back to the last splice, the left chunk grows instead. In the worst case
(one giant pre-token) the text is encoded in one piece, so the count is exact.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.common import in_batches, load_tokenizer
from vecmill.llm.packing import WordMemo

GUARD = 64  # characters; longer than every special string

#: Normalisation that joins nothing over white space, and pre-tokens that hold none.
APART = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def words_stand_alone(tokenizer) -> bool:
    """Whether the ids of every text are those of its words, parted at ASCII white space, one after another, each word by itself.

    Told by what the tokenizer consists of; of others than those of ``APART`` it is not claimed.
    """
    parts = [json.loads(x.__getstate__()) if x else None for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    special = tokenizer.get_added_tokens_decoder().values()
    return (tuple(parts) == APART and getattr(tokenizer.model, "end_of_word_suffix", None) == "</w>" and not tokenizer.model.dropout
        and tokenizer.truncation is None and tokenizer.padding is None
        and not any(t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in special))


def _starts(encoding, base: int) -> dict[int, int]:
    """Absolute offset of each pre-token's first token -> index of that token.

    Of pre-tokens made from one character (lower-casing may make two) the first counts.
    """
    words, offsets = encoding.word_ids, encoding.offsets
    return {base + offsets[i][0]: i for i in reversed(range(len(words))) if i == 0 or words[i] != words[i - 1]}


def _composes(c: str) -> bool:
    """Whether normalisation may join the character to the one before it, or make several of it."""
    return unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF or len(unicodedata.normalize("NFC", c).lower()) != 1


def spliced_ids(text: str, tokenizer, chunk_chars: int = 65536, overlap_chars: int = 512) -> list[int]:
    """Ids of the whole text, from overlapping chunks. Equal to encoding it at once."""
    n, ids = len(text), []
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    base, skip, anchor, end = 0, 0, 0, min(n, chunk_chars)  # left chunk: text[base:end], valid from token skip at offset anchor
    left = encode(base, end)
    while end < n:
        overlap, cut = overlap_chars, None
        while cut is None and end - overlap > anchor:
            start = end - overlap
            stop = min(n, start + max(chunk_chars, 2 * overlap))
            right = encode(start, stop)
            ours, theirs = _starts(left, base), _starts(right, start)
            cut = max((o for o in ours.keys() & theirs.keys() if start < o <= end - GUARD and ours[o] > skip and not _composes(text[o])), default=None)
            overlap *= 2
        if cut is None:  # nothing to align on: grow the left chunk from its own proven start
            base, skip, end = anchor, 0, min(n, end + max(chunk_chars, end - anchor))
            left = encode(base, end)
            continue
        ids += left.ids[skip : ours[cut]]
        base, skip, anchor, end, left = start, theirs[cut], cut, stop, right
    return ids + left.ids[skip:]


def count_tokens(texts: pa.Array, tokenizer, memo: WordMemo | None = None, huge_chars: int = 65536, batch_chars: int = 1 << 20,
    **splice) -> np.ndarray:
    """How many tokens each text has (null: none). ``memo``: where words stand alone, what counts them."""
    counts, chars = np.zeros(len(texts), np.int64), pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
    for i in np.flatnonzero(chars > huge_chars):
        counts[i] = len(spliced_ids(texts[int(i)].as_py(), tokenizer, **splice))
    batch = np.flatnonzero((chars > 0) & (chars <= huge_chars))
    while len(batch):
        end = max(1, int(np.searchsorted(np.cumsum(chars[batch]), batch_chars, "right")))
        some, which = texts.take(pa.array(batch[:end])), batch[:end]
        own = memo.counts_of(some) if memo else None
        if own is None:
            own = [len(e) for e in tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
        counts[which] = own
        batch = batch[end:]
    return counts


def token_counts(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
        huge_chars: int = 65536
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids
    stay as they are, an empty table gives an empty result, other columns are
    ignored whatever their names. Map-only: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        memo = WordMemo(tok) if words_stand_alone(tok) else None  # for this task alone, so its memory ends with the task
        for b in batches:
            counts = count_tokens(b.column("text"), tok, memo, huge_chars)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return in_batches(slim, run, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.llm.common import load_tokenizer
from vecmill.llm.packing import WordMemo, pack, plan_sequences
from vecmill.llm.token_counts import count_tokens, spliced_ids, token_counts, words_stand_alone

TOKENIZER = "word_bpe_49k.json"
PIECES = ["the ", "é", "é", " ", "\n", "'s", "'ll", "''re", "<|endoftext|>", "<|startoftext|>", "<|endof", "12", "漢字", "。", "각", "ᄀ", "ᅡ", "ᆨ", "ß", "!!", " ", "\x1c", "x" * 40, "İ", "Σ", "don't", "Word,"]


def ids_of(text):
    return load_tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=200), st.sampled_from([80, 150, 300]), st.sampled_from([4, 16, 70]))
def test_splices_equal_whole(pieces, chunk, overlap):
    text = "".join(pieces)
    assert spliced_ids(text, load_tokenizer(TOKENIZER), chunk, overlap) == ids_of(text)


def test_overlap_widens_over_one_giant_word():
    text = "a b " + "y" * 1500 + " c d " * 50
    assert spliced_ids(text, load_tokenizer(TOKENIZER), 200, 16) == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=80))
def test_words_equal_whole(pieces):
    text = "".join(pieces)
    memo = WordMemo(load_tokenizer(TOKENIZER), limit=20, longest=6)
    for _ in range(2):
        assert memo.ids([text, text]) == [np.array(ids_of(text), "<u4").tobytes()] * 2


def test_counts(docs, corpus, nothing):
    got = token_counts(docs, huge_chars=500)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i, len((t or "").encode()), len(ids_of(t or "")), len(ids_of(t or "")) > 2048) for i, t, *_ in corpus)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert token_counts(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "\xa0", "\u2028", "\x85", "\u0301", "\u0345"]), max_size=30), max_size=8), st.sampled_from([1, 20, 1 << 22]))
def test_counts_of_words_equal_whole(pieces, batch):
    texts = ["".join(p) for p in pieces] + [None]
    tok = load_tokenizer(TOKENIZER)
    memo, want = WordMemo(tok, limit=20, longest=6), [len(ids_of(t or "")) for t in texts]
    for _ in range(2):
        assert memo.counts_of(pa.array(texts, pa.string()), most=2.0).tolist() == want
        assert count_tokens(pa.array(texts * 3, pa.string()), tok, memo, huge_chars=60, batch_chars=batch).tolist() == want * 3


def test_repeated_words_are_encoded_once(spark, monkeypatch):
    """What the library is given follows the different words, not the length of the texts."""
    from vecmill.llm import token_counts as module

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.chars = tokenizer, 0

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **how):
            self.chars += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **how)

    counted, runs = Counted(load_tokenizer(TOKENIZER)), []
    monkeypatch.setattr(module, "load_tokenizer", lambda name: counted)
    monkeypatch.setattr(module, "in_batches", lambda rows, run, schema: runs.append(run) or rows.sparkSession.createDataFrame([], schema))
    token_counts(spark.createDataFrame([], "doc_id long, text string"))
    words = [f"word{i}," for i in range(200)]
    texts = [" ".join(random.Random(n).choices(words, k=300)) for n in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([len(t) for t in texts]), pa.array(texts)], ["id", "n_bytes", "text"])
    out = [n for b in runs[0](iter([batch.slice(0, 50), batch.slice(50)])) for n in b.column("n_tokens").to_pylist()]
    assert out == [len(ids_of(t)) for t in texts]
    assert counted.chars < sum(map(len, texts)) / 50
    counted.chars, once = 0, [" ".join(f"{n}x{i}" for i in range(300)) for n in range(100)]
    assert count_tokens(pa.array(once), counted, WordMemo(counted)).tolist() == [len(ids_of(t)) for t in once]
    assert counted.chars == sum(map(len, once))  # words that do not repeat: whole texts, and these once


def test_tokenizers_of_other_kinds_encode_whole_texts(spark, tmp_path):
    """White space that belongs to tokens, or to special strings, is no boundary."""
    from tokenizers import AddedToken, Tokenizer

    texts = ["two  words", "a b", "x <|a b|> y", "one   <|c|>   two", ""]
    kinds = {"byte_bpe_50k.json": [], TOKENIZER: [AddedToken("<|a b|>", normalized=False)], f"./{TOKENIZER}": [AddedToken("<|c|>", lstrip=True, normalized=False)]}
    assert words_stand_alone(load_tokenizer(TOKENIZER))
    for n, (name, more) in enumerate(kinds.items()):
        tok = Tokenizer.from_str(load_tokenizer(name.removeprefix("./")).to_str())
        tok.add_tokens(more)
        tok.save(path := f"{tmp_path}/{n}.json")
        assert not words_stand_alone(tok)
        got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path)
        assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_pack(docs, corpus, nothing):
    got = pack(docs, slice_rows=5).collect()
    want = Counter()
    for i, t, *_ in corpus:
        ids = [*ids_of(t or ""), 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want[(i, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 1
    assert pack(nothing).count() == 0


def test_null_and_shared_ids(spark):
    rows = [(None, "a text"), (None, "a text"), (4, "other words"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_crc32", F.lit("clash"))
    want = sorted((i or -1, len(ids_of(t or ""))) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts(df).collect()) == want
    got = pack(df).collect()
    assert sorted((r.doc_id or -1, r.length - 1) for r in got) == want
    assert len({r.sequence_id for r in got}) == 1


def test_memory_of_words_is_bounded():
    """Whatever is shown: twenty times as many words as are kept, and words too long to keep."""
    memo, rng = WordMemo(load_tokenizer(TOKENIZER), limit=3000), random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 30))) for _ in range(500)) for _ in range(6)]
        assert memo.ids(texts) == [np.array(ids_of(t), "<u4").tobytes() for t in texts]
        assert len(memo.known) == len(memo.sizes) <= 3000 and memo.sizes.sum() == len(memo.values)
        assert memo.known.nbytes + memo.sizes.nbytes + memo.values.nbytes < 3000 * (24 + 4 + 8 + 4 * 24)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_fills(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(rng.choice([1, 30, 3000])))
    used = Counter()
    plan = plan_sequences(dict(counts), 64)
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for n in pattern:
            used[n] += times
    assert used == counts
    bound = -(-sum(n * c for n, c in counts.items()) // 64)
    assert sum(t for _, t in plan) <= bound + max(1, bound // 50)


def test_exact_complements_come_first():
    assert plan_sequences({60: 2, 4: 1, 3: 1, 1: 1}, 64) == [((60, 4), 1), ((60, 3, 1), 1)]
    assert plan_sequences({50: 1, 8: 1, 5: 1, 1: 1, 13: 1}, 64)[0][0] in ((50, 13, 1), (50, 8, 5, 1))

import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.embedding import models
from vecmill.embedding.engine import ORIGINAL, AiEngine
from vecmill.embedding.front import ImageFront, SoundFront, TextFront
from vecmill.embedding.models import MODELS, HashEmbedder, ModelSpec, Registry
from vecmill.errors import DimensionMismatch, InvalidArgument
from vecmill.functions import sound, vision
from vecmill.functions.codec import from_literal, from_tagged, to_tagged
from vecmill.operators.predicates import Equals, NotEquals
from vecmill.plans.engine import Count, Engine, SetResult
from vecmill.sources.vecs import read_vecs
from vecmill.types import META, VALUE, audio, image, text


@pytest.fixture
def ai(spark):
    class Words:  # local, so that workers get it by value
        """A vector for each word: none, one or many."""

        def __call__(self, inputs, params):
            one = HashEmbedder(4)
            return [[(one([w], {})[0][0][0], {"word": w}) for w in x.decode().split()] for x in inputs]

    specs = {"hash": ModelSpec("hash", "str", 4, 2), "wide": ModelSpec("wide", "str", 5, 2), "words": ModelSpec("words", "img", 4, 2, one_to_many=True, needs_preprocessing=True)}
    return AiEngine(Engine(spark), Registry({"hash": lambda: HashEmbedder(4), "wide": lambda: HashEmbedder(5), "words": Words}, specs))


def test_texts(ai):
    ai.create_store("s", "hash", "hash", ["kind"], store_original=True)
    assert ai.set("s", [(text("a"), {"kind": "x"}), (text("b"), {"kind": "y"}), (text("c"), None)]) == SetResult(3, 0)
    ai.set("s", [(text("a"), {"kind": "z"})])
    assert ai.engine.rows("s").count() == 3
    rows = {r["key"]["str"]: {k: v["str"] for k, v in r["value"].items()} for r in ai.get_pred("s", NotEquals("kind", "none")).collect()}
    assert rows == {"a": {"kind": "z"}, "b": {"kind": "y"}, "c": {}}
    near = ai.get_sim_n("s", text("b"), 1).first()
    assert near["key"]["str"] == "b" and near["similarity"] == pytest.approx(1)
    assert ai.upsert("s", Equals("kind", "y"), text("d"), {"more": "1"}) == SetResult(0, 1)
    assert [r["key"]["str"] for r in ai.get_key("s", [text("d"), text("b")]).collect()] == ["d"]
    assert ai.del_key("s", [text("d"), text("none")]) == Count(1)
    info = ai.get_store("s").first()
    assert (info["query_model"], info["predicates"], info["len"]) == ("hash", ["kind"], 2)
    assert ai.drop_pred_index("s", [ORIGINAL, "kind"]) == Count(1) and ORIGINAL in ai.engine.store("s").meta.predicates
    assert ai.purge_stores() == Count(1)


def test_a_set_that_fails_loses_nothing(spark):
    """An input's old vectors go only if all new ones can be set."""
    class Grows:
        def __call__(self, inputs, params):
            return [[([1.0, 2.0, float(len(x))] + [0.0] * (params.get("long") == "1"), {})] for x in inputs]

    ai = AiEngine(Engine(spark), Registry({"grows": Grows}, {"grows": ModelSpec("grows", "str", 3, 8)}))
    ai.create_store("s", "grows", "grows", store_original=True)
    ai.set("s", [(text("a"), {}), (text("bb"), {})])
    with pytest.raises(DimensionMismatch):
        ai.set("s", [(text("a"), {}), (text("ccc"), {})], params={"long": "1"})
    assert sorted(r["key"]["str"] for r in ai.get_pred("s", NotEquals("x", "y")).collect()) == ["a", "bb"]
    ai.set("s", [(text("a"), {"again": "1"}), (text("ccc"), {})])
    assert sorted((r["key"]["str"], len(r["value"])) for r in ai.get_pred("s", NotEquals("x", "y")).collect()) == [("a", 1), ("bb", 0), ("ccc", 0)]


def test_one_to_many(ai):
    ai.create_store("s", "words", "words")
    assert ai.set("s", [(image(b"one two"), {"pic": "1"}), (image(b""), {"pic": "2"}), (image(b"three"), {})]) == SetResult(3, 0)
    got = sorted((r["value"]["word"]["str"], "pic" in r["value"]) for r in ai.get_pred("s", NotEquals("x", "y")).collect())
    assert got == [("one", True), ("three", False), ("two", True)]
    for bad in (lambda: ai.get_sim_n("s", image(b"a b"), 1), lambda: ai.get_sim_n("s", image(b""), 1), lambda: ai.upsert("s", Equals("pic", "1"), image(b"x")), lambda: ai.get_key("s", [image(b"x")])):
        with pytest.raises(InvalidArgument):
            bad()
    assert ai.convert([image(b"a b c")], "words").count() == 3


def test_model_errors(ai):
    for bad in (
        lambda: ai.create_store("x", "hash", "wide"), lambda: ai.create_store("x", "hash", "unknown"), lambda: ai.create_store("x", "hash", "hash", [ORIGINAL]),
        lambda: ai.models.embed("hash", [image(b"")]), lambda: ai.models.embed("words", [image(b"")], preprocess=False),
    ):
        with pytest.raises(InvalidArgument):
            bad()
    ai.create_store("s", "hash", "hash")
    for bad in (lambda: ai.set("s", [(audio(b""), {})]), lambda: ai.set("s", [(text("a"), {ORIGINAL: "b"})])):
        with pytest.raises(InvalidArgument):
            bad()


@given(st.one_of(st.text().map(text), st.binary().map(image), st.binary().map(audio)))
def test_tagged_round_trip(v):
    assert from_tagged(to_tagged(v)) == v


def test_literals():
    assert from_literal("/x0aFF") == image(b"\n\xff") and from_literal("/a") == audio(b"") and from_literal("/xyz") == text("/xyz") and from_literal("plain") == text("plain")
    with pytest.raises(ValueError):
        from_tagged("odd:1")


def test_vecs(spark, tmp_path):
    rows = [[1.5, 2.5, -3.0], [4.0, 5.0, 6.0]]
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, *r) for r in rows))
    (tmp_path / "b.ivecs").write_bytes(struct.pack("<i2i", 2, 7, 8))
    assert [r["vector"] for r in read_vecs(spark, f"{tmp_path}/a.fvecs").orderBy("pos").collect()] == rows
    assert read_vecs(spark, f"{tmp_path}/b.ivecs", floats=False).first()["vector"] == [7, 8]


def test_boxes(spark):
    assert vision.suppress(np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]], float), np.array([0.8, 0.9, 0.5]), 0.4) == [1, 2]
    b = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0], 0.8), (1, [1.0, 1.0, 11.0, 11.0], 0.9), (2, [0.0, 0.0, 0.0, 0.0], 0.1)], "image_id long, box array<double>, confidence double")
    assert sorted(r["confidence"] for r in vision.nms(b).collect()) == [0.1, 0.9]
    got = spark.range(1).select(vision.iou(F.array(*map(F.lit, [0.0, 0.0, 2.0, 2.0])), F.array(*map(F.lit, [1.0, 1.0, 3.0, 3.0]))), vision.iou(F.array(*[F.lit(0.0)] * 4), F.array(*[F.lit(0.0)] * 4))).first()
    assert got[0] == pytest.approx(1 / 7) and got[1] == 0
    box = spark.range(1).select(vision.unletterbox(F.array(*map(F.lit, [0.0, 160.0, 320.0, 480.0])), F.lit(1280), F.lit(640), 640)).first()[0]
    assert box == pytest.approx([0, 0, 0.5, 1])


def test_detectors():
    outputs = []
    for s in (8, 16, 32):
        n = 2 * (64 // s) ** 2
        outputs += [np.zeros((n, 1)), np.ones((n, 4)), np.zeros((n, 10))]
    outputs[3][5, 0] = 0.9  # stride 16: cell 2 of row 0
    outputs[0][0, 0] = np.nan
    boxes, points, scores = vision.decode_distances(outputs[::-1], 0.5, 64)
    assert boxes.tolist() == [[16, -16, 48, 16]] and scores.tolist() == [0.9] and points[0, 0].tolist() == [32, 0]
    n = 64
    cls, obj, box, pts = np.zeros((n, 1)), np.ones((n, 1)), np.zeros((n, 4)), np.zeros((n, 10))
    cls[9, 0], box[9] = 0.7, [0, 0, 2, 4]
    boxes, points, scores = vision.decode_centres({8: (cls, obj, box, pts)}, 0.6, 64)
    assert boxes.tolist() == [[4, 0, 20, 28]] and points[0, 4].tolist() == [12, 12]
    with pytest.raises(ValueError):
        vision.decode_distances(outputs[:3], 0.5, 64)


def test_images_are_dealt_and_leave_in_whole_batches(spark, tmp_path):
    """A file of one row group is worked on by many tasks; results leave a worker by thousands, not by the model's batch."""
    from vecmill import command_queries as Q
    from vecmill.embedding import models

    spark.createDataFrame([(i, i % 50 + 1, 1.0 * i) for i in range(1, 400)], "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for q in (Q.ai_images, Q.decoded_distances):
        got = q(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4 and got.count() == 399
    b = pa.RecordBatch.from_pylist([{"pos": i, "input": {"kind": "img", "str": None, "bin": b"x"}, "value": None} for i in range(100)],
        pa.schema([("pos", pa.int64()), ("input", to_arrow_type(META)), ("value", to_arrow_type(VALUE))]))
    made = models._made(b, [3, 3], [0, 1], [[1.0], [2.0]], [{"a": "b"}, {}])
    assert made.column("pos").to_pylist() == [3, 3] and [len(m) for m in made.column("value").to_pylist()] == [1, 0]


def test_resize_is_bilinear():
    p = np.random.default_rng(1).normal(size=(5, 7, 3))
    for h, w in ((8, 8), (3, 20), (5, 7), (1, 1)):
        y, x = np.mgrid[:h, :w]
        sx, sy = np.clip((x + 0.5) * 7 / w - 0.5, 0, 6), np.clip((y + 0.5) * 5 / h - 0.5, 0, 4)
        assert np.allclose(vision.resize(p, h, w), vision._bilinear(p, sx.ravel(), sy.ravel()).reshape(h, w, 3))


def test_pictures():
    t = vision.similarity_from_eyes([10, 10], [20, 10], [5, 5], [5, 15])
    assert np.allclose(t @ [20, 10, 1], [5, 15]) and np.allclose(t @ [10, 10, 1], [5, 5])
    p = np.arange(48.0).reshape(4, 4, 3)
    assert np.allclose(vision.warp(p, np.array([[1.0, 0, 0], [0, 1, 0]]), 4), p)
    assert np.allclose(vision.resize(p, 4, 4), p) and vision.letterbox(p, 8).shape == (8, 8, 3)
    assert vision.centre_crop(p, 2, 2).tolist() == p[1:3, 1:3].tolist() and vision.centre_crop(p, 6, 6)[1:5, 1:5].tolist() == p.tolist()
    assert vision.to_tensor(np.full((2, 2, 3), 255.0), (0.5,) * 3, (0.5,) * 3).tolist() == np.ones((3, 2, 2)).tolist()


def test_sound():
    f = sound.mel_filters()
    assert f.shape == (64, 513) and (f.sum(1) > 0).all() and np.allclose(sound.hertz(sound.mel(440.0)), 440)
    tone = np.sin(2 * np.pi * 1000 * np.arange(24_000) / 24_000)
    out = sound.features(np.stack([tone, tone], 1), 24_000)
    assert out.shape == (1, 1000, 64)
    peak = out[0, 10].argmax()
    edges = sound.hertz(np.linspace(sound.mel(50), sound.mel(14000), 66))
    assert edges[peak] < 1000 < edges[peak + 2] and (out[0, 998:] == 0).all()
    with pytest.raises(ValueError):
        sound.repeat_to(np.zeros(3), 2)


def test_text_front(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    t = Tokenizer(models.WordLevel({"[S]": 0, "[E]": 1, "a": 2, "b": 3, "[U]": 4}, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[S] $A [E]", special_tokens=[("[S]", 0), ("[E]", 1)])
    t.save(str(tmp_path / "t.json"))
    ready = TextFront(str(tmp_path / "t.json"), 4)
    assert ready(["a b a b", "z"], True).ids.tolist() == [[0, 2, 3, 2], [0, 4, 1, 0]]
    with pytest.raises(InvalidArgument):
        ready(["a b a b"], False)
    assert ready(["a b"], False).ids.tolist() == [[0, 2, 3, 1]]


def ppm(picture):
    h, w, _ = picture.shape
    return f"P6\n# made here\n{w} {h}\n255\n".encode() + picture.astype(np.uint8).tobytes()


def test_image_front():
    rng = np.random.default_rng(1)
    picture = rng.integers(0, 256, (8, 8, 3))
    plain = ImageFront(8, (0, 0, 0), (1, 1, 1))
    assert np.allclose(plain([ppm(picture)], True)[0], picture.transpose(2, 0, 1) / 255)
    assert np.allclose(plain([ppm(picture)], False)[0], picture.transpose(2, 0, 1))
    wide = np.zeros((4, 12, 3))
    wide[:, :4], wide[:, 4:8], wide[:, 8:] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    middle = plain([ppm(wide)], True)[0]
    assert middle.shape == (3, 8, 8) and np.allclose(middle[1, :, 1:7], 1)
    boxed = ImageFront(12, (0, 0, 0), (1, 1, 1), boxed=True)([ppm(wide)], True)[0]
    assert boxed[:, :4].max() == 0 and boxed[0, 6, 0] == 1 and boxed[2, 6, 11] == 1
    assert plain([], True).shape == (0, 3, 8, 8)
    for bad in (b"P6\n9 9\n255\nshort", b"no picture"):
        with pytest.raises(InvalidArgument):
            plain([bad], True)
    with pytest.raises(InvalidArgument):
        plain([ppm(wide)], False)


def test_sound_front():
    def wav(samples, rate, channels):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes((samples * 32767).astype("<i2").tobytes())
        return out.getvalue()

    ready = SoundFront()
    tone = np.sin(np.arange(24_000) * 2 * np.pi * 1000 / 24_000)
    got = ready([wav(np.repeat(tone, 2), 24_000, 2)], True)
    assert got.shape == (1, 1, 1000, 64) and got[0, 0, 500].argmax() == sound.log_mel(np.sin(np.arange(480_000) * 2 * np.pi / 48))[500].argmax()
    assert np.allclose(ready([wav(np.zeros(480_000), 48_000, 1)], False).max(), 0)
    for bad, preprocess in ((wav(tone, 24_000, 1), False), (b"no sound", True), (wav(np.zeros(500_000), 48_000, 1), True), (wav(np.zeros(0), 48_000, 1), True)):
        with pytest.raises(InvalidArgument):
            ready([bad], preprocess)


def test_thresholds_have_defaults():
    faces, other = MODELS["buffalo-l"], MODELS["sface-yunet"]
    assert faces.parameters(None) == {"confidence_threshold": "0.5", "nms_threshold": "0.4"}
    assert faces.parameters({"nms_threshold": "x", "attributes": " genderage,hat"}) == {"confidence_threshold": "0.5", "nms_threshold": "0.4", "attributes": "genderage"}
    assert other.parameters({"nms_threshold": "0.9"}) == {"confidence_threshold": "0.6", "nms_threshold": "0.4"}
    assert MODELS["resnet-50"].parameters({"any": "1"}) == {"any": "1"}


def test_idle_models_are_dropped(monkeypatch):
    now, made = [0.0], []
    monkeypatch.setattr(models, "_MODELS", {})
    monkeypatch.setattr(models.time, "monotonic", lambda: now[0])

    def of(name):
        return models.Registry({name: lambda: made.append(name) or HashEmbedder(2)}, {name: ModelSpec(name, "str", 2, 1)})

    a, b = of("a"), of("b")
    for when, registry, name in ((0, a, "a"), (10, b, "b"), (200, a, "a"), (320, a, "a"), (330, b, "b"), (900, b, "b"), (910, a, "a")):
        now[0] = when
        registry.embed(name, [text("x")])
    assert made == ["a", "b", "b", "a"] and set(models._MODELS) == {"a", "b"}

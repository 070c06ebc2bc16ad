import pytest

from vecmill.errors import ParseError
from vecmill.operators.predicates import And, Equals, In, NotEquals, NotIn, Or
from vecmill.plans import commands as C
from vecmill.plans.dsl import parse
from vecmill.types import Hnsw, KdTree, audio, image, text


def one(source, ai=False):
    (c,) = parse(source, ai)
    return c


@pytest.mark.parametrize(
    ("source", "command"),
    [
        ("ping;\n;ListClients ", [C.Ping(), C.ListClients()]),
        ("liststores schema lab", [C.ListStores("lab")]),
        ("getstore atlas", [C.GetStore("atlas")]),
        ("CreateStore if not exists atlas dimension 12 predicates (sea, river) schema maps", [C.CreateStore("atlas", 12, ("sea", "river"), (), False, "maps")]),
        ("createstore birds dimension 4 nonlinearalgorithmindex (hnsw, kdtree)", [C.CreateStore("birds", 4, (), (Hnsw(), KdTree()), True)]),
        ("DropStore birds", [C.DropStore("birds", True)]),
        ("dropstore birds if exists schema zoo", [C.DropStore("birds", False, "zoo")]),
        ("createpredindex (wing) in birds; DROPPREDINDEX (wing) in birds", [C.CreatePredIndex("birds", ("wing",)), C.DropPredIndex("birds", ("wing",), True)]),
        ("dropnonlinearalgorithmindex if exists (hnsw, kdtree) in birds", [C.DropNonLinearIndex("birds", ("hnsw", "kdtree"), False)]),
        ("GetKey ([0.5, -2]) in birds schema zoo", [C.GetKey("birds", ((0.5, -2.0),), "zoo")]),
        ("getsimn 4 with [1e1] using dotproductsimilarity in birds", [C.GetSimN("birds", (10.0,), 4, "dot")]),
        ("getsimn 2 with [3, 4] using hnsw in birds schema zoo where (colour != grey)", [C.GetSimN("birds", (3.0, 4.0), 2, "hnsw", NotEquals("colour", text("grey")), "zoo")]),
        (
            "getpred ((legs in (2, 4)) or (colour not in (red))) in birds",
            [C.GetPred("birds", Or(In("legs", (text("2"), text("4"))), NotIn("colour", (text("red"),))))],
        ),
        ("set (([7], {call: /x0102, song: /a7f, name: great tit })) in birds", [C.Set("birds", (((7.0,), {"call": image(b"\x01\x02"), "song": audio(b"\x7f"), "name": text("great tit ")}),))]),
        ("upsert ([8], {name: wren}) where (name = tit) in birds merge", [C.Upsert("birds", Equals("name", text("tit")), (8.0,), {"name": text("wren")}, True)]),
        ("delpred (name in (\"a, b\", c)) in birds", [C.DelPred("birds", In("name", (text("a, b"), text("c"))))]),
    ],
)
def test_statements(source, command):
    assert parse(source) == command


def test_and_or_nest_to_the_right():
    got = one("GETPRED ((a = 1) and (b = 2) or (c = 3)) in s").condition
    assert got == And(Equals("a", text("1")), Or(Equals("b", text("2")), Equals("c", text("3"))))


def test_raw_inputs():
    made = one("createstore if not exists shelf querymodel all-minilm-l12-v2 indexmodel bge-large-en-v1.5 predicates (row) storeoriginal schema hall", True)
    assert made == C.AiCreateStore("shelf", "all-minilm-l12-v2", "bge-large-en-v1.5", ("row",), (), False, True, "hall")
    assert one("set (([a red book], {row: 3})) in shelf schema hall preprocessaction modelpreprocessing", True) == C.AiSet("shelf", ((text("a red book"), {"row": text("3")}),), True, None, {}, "hall")
    assert one("getsimn 5 with [some book] using euclideandistance preprocessaction nopreprocessing executionprovider cpu in shelf where (row = 3)", True) == C.AiGetSimN("shelf", text("some book"), 5, "euclidean", Equals("row", text("3")), False, "cpu", {}, None)
    assert parse("PurgeStores; getkey ([/x41], [two words]) in shelf", True) == [C.PurgeStores(), C.AiGetKey("shelf", (image(b"A"), text("two words")))]


def test_quotes_enclose_or_belong_to_a_value():
    source = "getpred (name = 'tit') in birds"
    assert one(source).condition == Equals("name", text("tit"))
    assert parse(source, quotes=False)[0].condition == Equals("name", text("'tit'"))
    assert parse("getpred (name in ('a, b')) in birds", quotes=False)[0].condition == In("name", (text("'a"), text("b'")))


@pytest.mark.parametrize("source", ["fly ; ping", "getsimn none with [1] using hnsw in s", "getsimn 0 with [2] using hnsw in s", "createnonlinearalgorithmindex (balltree) in s", "set birds", "createstore x dimension", "getkey ([1, two]) in s", "ping twice"])
def test_errors_name_their_place(source):
    with pytest.raises(ParseError) as e:
        parse(source)
    assert 0 <= e.value.at <= len(source)

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweave.functions.segment import Segmenter, normal, squeeze
from lumenweave.operators.unpack import dictionary, unpack

NAMES = ["alpha, type 1", "beta, type 1", "gamma and fatigue complex", "delta and fatigue complex", "W46/13", "Tg(Ab,Cd)1", "3,6-drug", "plain", "K9 x W4 F1", "o'hara"]
S = Segmenter(NAMES)


@pytest.mark.parametrize(
    "cell, want",
    [
        (None, ()),
        ("", ()),
        (" \xa0", ()),
        ("nan", ()),
        ("-1", ()),
        ('["-1"]', ()),
        ("plain", ("plain",)),
        ('"plain"', ("plain",)),
        ("plain|", ("plain",)),
        ("plain| |W46/13", ("plain", "W46/13")),
        ("a|-1|b", ("a", "-1", "b")),
        ("alpha, type 1, plain", ("alpha, type 1", "plain")),
        ("Alpha,  type 1, PLAIN", ("Alpha,  type 1", "PLAIN")),
        ("new one, type 1; plain", ("new one, type 1", "plain")),
        ("new one, type 1", ("new one, type 1",)),
        ("unknown and fatigue complex", ("unknown and fatigue complex",)),
        ("plain, W46/13 and Tg(Ab,Cd)1", ("plain", "W46/13", "Tg(Ab,Cd)1")),
        ("plain, W46/13, and K9 x W4 F1", ("plain", "W46/13", "K9 x W4 F1")),
        ("plain / W46/13", ("plain", "W46/13")),
        ("plain & tg(ab,cd)1", ("plain", "tg(ab,cd)1")),
        ("3,6-drug,plain,4,8-other", ("3,6-drug", "plain", "4,8-other")),
        ("['plain', \"o'hara\"]", ("plain", "o'hara")),
        ('["alpha, type 1","plain"]', ("alpha, type 1", "plain")),
        ('"alpha, type 1", plain', ("alpha, type 1", "plain")),
        ('"plain|W46/13', ("plain", "W46/13")),
        ('plain|W46/13"', ("plain", "W46/13")),
        ("1. plain, 2. W46/13", ("plain", "W46/13")),
        ("1) plain 2) W46/13", ("plain", "W46/13")),
        ("(1) plain; (2) W46/13", ("plain", "W46/13")),
        ("M:1 M:2 -1", ("M:1", "M:2", "-1")),
        ("plain\r\nW46/13\tx", ("plain", "W46/13", "x")),
        ("plain¦W46/13｜x", ("plain", "W46/13", "x")),
        ("x|x", ("x", "x")),
    ],
)
def test_cells(cell, want):
    assert S.segment(cell) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(NAMES), min_size=1, max_size=6), st.sampled_from(["|", ";", " | ", "\n", ", ", " / "]))
def test_known_values_come_back(values, sep):
    assert list(S.segment(sep.join(values))) == values


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab,;|/\"'[]() 1.&\n\xa0", max_size=60))
def test_any_text_is_cut_without_failing(text):
    for v in S.segment(text):
        assert v and v == v.strip() and normal(v)


def test_squeeze_keeps_places():
    low, at = squeeze("A \xa0B")
    assert low == "a b" and [("A \xa0B")[i] for i in at] == ["A", " ", "B"]


def test_values_of_many_pieces():
    names = ["a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, p, q, r, s, t", "mouse", "x, early", "y, early", "x, late", "y, late"]
    cut = Segmenter(names).segment
    assert cut(names[0]) == (names[0],) and cut(f"{names[0]} | mouse") == (names[0], "mouse") and cut(f"mouse, {names[0]}") == ("mouse", names[0])
    assert cut("z" + ", early, late" * 6) == ("z" + ", early, late" * 6,)
    assert len(cut(", ".join(f"u{i}" for i in range(3000)))) == 3000


def test_long_cell():
    assert len(S.segment("|".join(["alpha, type 1"] * 5000))) == 5000


def test_unpack(spark):
    rows = [(1, "plain|alpha, type 1", "x"), (1, "plain|alpha, type 1", "x"), (2, None, "y"), (3, "plain", "z"), (None, "plain;W46/13", "z"), (4, "-1", "")]
    df = spark.createDataFrame(rows, "id bigint, cell string, pos string").withColumn("item_text", F.lit("clash"))
    got = sorted((r.row_id or 0, r.pos, r.item_text) for r in unpack(df, "id", "cell", NAMES, 2, "t").collect())
    assert got == [(0, 1, "plain"), (0, 2, "W46/13"), (1, 1, "plain"), (1, 1, "plain"), (1, 2, "alpha, type 1"), (1, 2, "alpha, type 1")]
    one = sorted((r.row_id or 0, r.item_text) for r in unpack(df, "id", "cell", NAMES, 1).collect())
    assert (3, "plain") in one and len(one) == 7
    assert unpack(df.limit(0), "id", "cell", NAMES, 2).count() == 0


def test_dictionary_is_bounded(spark):
    with pytest.raises(ValueError):
        dictionary(spark.range(10).select(F.col("id").cast("string")), most=5)

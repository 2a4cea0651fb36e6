import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.operators import entities as N
from lumenweave.operators import models as M
from lumenweave.operators import relational as R


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.coalesce(1).select(column(F.col("x"))).collect()]


def test_drugs(spark):
    cases = {"Vitamin D|\"aspirin\"|# 0451|528|()|": "aspirin|vitamin D3", "GABA receptor agonist|x": "GABA receptor agonist|x", "fty720-c2|FTY720-C2": "Fingolimod", "mir-1192": "mir-1192", "β-x1|ok1": "ok1", None: None, "": ""}
    assert one(spark, N.clean_drugs, *cases) == list(cases.values())


def test_sets_by_type(spark):
    kind = "array<struct<kind:string,entity:string>>"
    rows = [("DRUG", "ASA"), ("DRUG", "##x"), ("DRUG", "a"), ("DISEASE", "MS"), ("DRUG", "Aspirin")]
    short = F.create_map(F.lit("ASA"), F.lit("Aspirin"), F.lit("MS"), F.lit("multiple sclerosis"))
    assert one(spark, lambda c: N.by_type(c, "DRUG", short), rows, [], None, kind=kind) == ["aspirin", "", None]
    assert one(spark, lambda c: N.by_type(c, "DISEASE", short), rows, kind=kind) == ["multiple sclerosis"]


def test_title_spans(spark):
    spans = [(0, 4, "DRUG", "Abcd"), (0, 4, "DRUG", "other"), (5, 99, "DRUG", "far"), (None, 4, "DRUG", "null"), (0, 4, "DISEASE", "abcd")]
    df = spark.createDataFrame([("abcd title", spans)], "t string, s array<struct<start:int,stop:int,kind:string,text:string>>")
    r = df.select(N.in_title(F.col("t"), F.col("s"), "DRUG", True), N.in_title(F.col("t"), F.col("s"), "DRUG", False), N.in_title(F.col("t"), F.col("s"), "DISEASE", True)).first()
    assert r[:] == (["Abcd"], ["other", "far", "null"], ["abcd"])


def test_countries(spark):
    cases = {"Univ, Wales": "United Kingdom", "usage of x": None, "Wien, Österreich.": "Austria", "U.S.A.": "United States", "Germany and then China": "China", None: None, "": None}
    assert one(spark, N.country_of, *cases) == list(cases.values())
    said = {"Department of Medicine": True, "Harvard": True, "Harvard, Boston, MA": False, "USA": False, "": True, None: True, "A very long name of some institution here": False}
    assert one(spark, lambda c: N.skip_affiliation(c, N.country_of(c)), *said) == list(said.values())


def test_first_contained(spark):
    terms = spark.createDataFrame([(2, "als"), (1, "Motor Neuron"), (1, "motor"), (3, None)], "rank int, term string")
    df = spark.createDataFrame([("motor neuron and als",), ("false",), (None,), ("",)], "x string").withColumn("hit", F.lit(0))
    assert [(r["rank"], r.term) for r in N.first_contained(df, "x", terms).collect()] == [(1, "motor"), (2, "als"), (None, None), (None, None)]
    assert N.first_contained(df, "x", terms.limit(0)).where("rank is not null").count() == 0
    with pytest.raises(ValueError):
        N.first_contained(df, "x", terms, most=1)
    ranked = N.longest_first(terms.select("term").where("term is not null"), 3)
    assert N.first_contained(df, "x", ranked).first().term == "motor neuron"


def test_entity_scores(spark):
    df = spark.createDataFrame([("aspirin|ibuprofen", "aspirine|xyz1"), (None, "abc"), ("same", "SAME"), ("ab", "ab"), (None, None)], "t string, s string")
    got = {r.match: (r.tp, r.fp, r.fn) for r in N.entity_scores(df, "t", "s").collect()}
    assert got["exact"] == (1, 3, 2)
    assert got["partial"] == (3, 2, 1)


def test_models(spark):
    df = spark.createDataFrame([(1, "aa b"), (2, None), (3, "")], "id int, text string")
    got = {r.row_id: (r.label, r.confidence) for r in M.classify_texts(df, "id", "text", lambda ts: np.array([[len(t), 0.0] for t in ts]), ["long", "short"]).collect()}
    assert got[1][0] == "long" and abs(got[1][1] - 1 / (1 + np.exp(-4))) < 1e-9 and got[2] == (None, None) and got[3] == ("long", 0.5)
    words = M.tag_words(df, "id", "text", lambda ws: ["X" if w == "b" else "O" for w in ws], chunk=1).collect()
    assert [(r.row_id, r.begin, r.stop, r.word, r.tag) for r in words] == [(1, 3, 4, "b", "X")]

    def answer(text, n):
        if n == 1:
            raise OSError("away")
        return text[: n - 1]

    told = {r.row_id: (r.answer, r.valid, r.attempts) for r in M.generate(df, "id", "text", answer, lambda t, a: a == "aa", 3).collect()}
    assert told == {1: ("aa", True, 3), 3: (None, False, 3)} or told == {1: ("aa", True, 3), 3: ("", False, 3)}
    lists = spark.createDataFrame([(["a"], ["a", "b"]), (["c"], ["a"]), ([], ["a"]), (None, ["a"])], "p array<string>, o array<string>")
    assert [r[0] for r in lists.coalesce(1).select(M.constrained(F.col("p"), F.col("o"))).collect()] == [["a"], ["a"], ["a"], ["a"]]


def test_answers(spark):
    cases = {'x <json> {"a": 1} </json> {"b": 2}': '{"a": 1}', '```json\n{"a": {"b": 1}}\n```': '{"a": {"b": 1}}', 'no {"a": 1} yes {"a": 2}.': '{"a": 2}', "none {x": None, None: None}
    assert one(spark, M.json_of, *cases) == list(cases.values())


def test_numbered_and_splits(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise("b").alias("c")).repartition(7)
    assert [r.n for r in R.numbered(df, [F.desc("id")], "n").orderBy(F.desc("id")).collect()] == list(range(1, 1001))
    got = R.stratified(df, "c", "id", 0.8, 0.1)
    counts = {(r.c, r.split): r["count"] for r in got.groupBy("c", "split").count().collect()}
    assert got.count() == 1000 and got.columns == ["id", "c", "split"]
    assert counts["hot", "train"] == 268 and counts["hot", "dev"] == 33 and sum(n for (c, _), n in counts.items() if c == "hot") == 334
    parts = [r["count"] for r in R.split_runs(df, [F.col("id")], parts=7).groupBy("part").count().orderBy("part").collect()]
    assert parts == [143] * 6 + [142]
    assert R.numbered(df.limit(0), [F.col("id")], "n").count() == 0

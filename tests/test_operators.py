import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import biology as B
from lumenweave.functions import cells as C
from lumenweave.operators import classify as K
from lumenweave.operators import evaluate as E
from lumenweave.operators import linking as L
from lumenweave.operators import ontology as G
from lumenweave.operators import relational as R
from lumenweave.operators import translation as T
from lumenweave.operators.skew import split_join
from lumenweave.sources import files as S
from lumenweave.sources.sections import from_html, from_plain, from_running, from_xml, grouped_by_span


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.coalesce(1).select(column(F.col("x"))).collect()]


def test_classifiers(spark):
    assert one(spark, K.sample_size, "No power analysis was done.", "The sample size was calculated.", "Mice.", None) == [2, 1, 0, 0]
    assert one(spark, K.blinding, "Observers were BLIND.", "none", None) == [1, 0, 0]
    assert one(spark, K.randomization, "randomly assigned to groups", "x") == [1, 0]
    assert one(spark, K.welfare, "approved by the Animal Committee", "approved by patients", "x") == [1, 0, 0]
    assert one(spark, K.age_mention, "8 weeks", "adult rats", "x") == [1, 1, 0]
    assert one(spark, K.sex, "animals of both sexes", "female rats", "male and female mice", "female patients", None) == ["sex-both", "sex-female", "sex-both", "sex-not-reported", "sex-not-reported"]


SENTENCES = {
    "rat and mice feed": ["species-other"],
    "Laboratory Rabbit Diet": ["species-other"],
    "guinea pigs and rats": ["rat", "guinea pig"],
    "mouse monoclonal antibody": ["species-other"],
    "Guinea pigs were kept. Other guinea pigs were fed.": ["guinea pig"],
    "no rats were used but a dog was": ["dog"],
    "It was not a rat but the mice ran.": ["mouse"],
    "cells isolated from rats one two three four five six seven eight nine ten eleven twelve thirteen fourteen; later rats ran": ["rat"],
    "Cat. # 12345 and the CAT assay": ["species-other"],
    "worn by a domestic cat near cats": ["cat"],
    "the squirrel monkeys and swine": ["monkey", "pig"],
    "Mice. J Neurosci 12 (3), 1999, 145-150": ["species-other"],
    "rabbit-anti-human factor in rats": ["species-other"],
    "ratschlag": ["species-other"],
    "RATS\nMICE": ["mouse", "rat"],
    "": ["species-other"],
    None: ["species-other"],
}


def test_species(spark):
    assert one(spark, K.species, *SENTENCES) == list(SENTENCES.values())
    long = "word " * 20_000 + "rats " * 2_000 + "antibody"
    assert one(spark, K.species, long) == [["rat"]]


def test_sex_looks_at_the_first_hit_of_each_pattern(spark):
    far = " ".join(["word"] * 12)
    cases = {
        "female patients; later the female rats": "sex-not-reported",
        f"females {far} patients": "sex-female",
        f"females {' '.join(['word'] * 11)} patients": "sex-not-reported",
        "females versus males": "sex-not-reported",
        "mothers and brothers": "sex-both",
        "rats of either sex": "sex-both",
        "pregnan mice": "sex-female",
        "Males\nonly": "sex-male",
    }
    assert one(spark, K.sex, *cases) == list(cases.values())


def test_numbers_in_animal_context(spark):
    df = spark.createDataFrame([(1, "In all 12 rats died. Of 12 patients none. 120 x", "n = 12, 12"), (2, None, "3"), (3, "a 7 (b", "7 (b"), (4, "all animals: 5", "5")], "id int, text string, n string")
    got = {(r.id, r.value, r.context, r.species, r.animal) for r in K.number_contexts(df, ["id"], "text", "n", 10).collect()}
    assert got == {(1, "12", "in all 12 rats died", "rat", True), (1, "12", " died. of 12 patients ", "species-other", False), (3, "7 (b", "a 7 (b", "species-other", False), (4, "5", " animals: 5", "species-other", True)}


def test_document_rules(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1), (2, 0, 0), (2, 1, 0)], "doc int, place int, code int")
    assert {tuple(r) for r in K.zero_fallback(df, "doc", "code", "place").collect()} == {(1, 2, "1,2"), (2, 0, "0,1")}
    sp = spark.createDataFrame([(1, 0, ["rat"]), (1, 1, ["rat"]), (1, 2, ["mouse"]), (2, 0, ["dog", "cat"]), (3, 0, ["species-other"])], "doc int, place int, labels array<string>")
    assert {tuple(r) for r in K.species_rule(sp, "doc", "labels", "place").collect()} == {(1, "rat", "2", "0,1"), (2, "cat,dog", "1,1", "0"), (3, "species-other", "1", "0")}


def test_numbers_and_ages(spark):
    assert [B.spelled_number(x) for x in ("n = 5", "thirty matured", "about 130", "one hundred and 62", "none", "two thousand and one")] == [5, 30, 130, 162, None, 2001]
    assert one(spark, B.number_of, "157", "n = 6", "twenty-one", None, "not reported") == [157, 6, 21, None, None]
    assert one(spark, B.plus_minus, "55.26 ± 6.44 weeks", "x") == ["48.82 weeks, 61.70 weeks", "x"]
    assert one(spark, B.lost_dash, 200, 812, 1014, 20, kind="int") == ["2-00", "8-12", "10-14", "20"]
    assert one(spark, B.repaired, "a - b", "c57bl / 6", "( x )") == ["a-b", "c57bl/6", "(x)"]
    assert one(spark, B.strain_key, "Velisk White mice", "W46KX/13J", "w46kx13") == ["veliskwhite", "w46kx13", "w46kx13"]


def test_cells(spark):
    df = spark.createDataFrame([(1, "a|b", "1|2"), (2, "a", "1|2"), (3, None, None)], "id int, a string, b string")
    rows, misfits = C.aligned(df, ["a", "b"], ["id"])
    assert [tuple(r) for r in rows.collect()] == [(1, 1, "a", "1"), (1, 2, "b", "2")] and {r.id for r in misfits.collect()} == {2, 3}
    assert one(spark, C.literal_list, "['a', 'b']", '["x"]', "plain", None, "[nan, 'y']") == [["a", "b"], ["x"], ["plain"], None, [None, "y"]]


def test_phases(spark):
    assert one(spark, T.phase_rank, "Phase 2/Phase 3", "PHASE2/PHASE3", "EARLY_PHASE1", None, "N/A") == [2.5, 2.5, 0, -1, -1]


def test_relational(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 3)], "k int, v string, o int")
    assert {tuple(r) for r in R.keep_first(df, ["k"], [F.col("o")]).collect()} == {(1, "a", 1), (2, None, 3)}
    assert {tuple(r) for r in R.keep_first_window(df, ["k"], [F.desc("o")]).collect()} == {(1, "b", 2), (2, None, 3)}
    bad = spark.createDataFrame([(1,), (None,)], "x int")
    assert [r.k for r in R.without(df, F.col("k"), bad).collect()] == [2]


def test_graph(spark):
    links = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "x"), ("x", "a"), ("e", "e2"), ("a", "r")], "child string, parent string")
    up = G.closure(links)
    got = {(r.node, r.ancestor): r.hops for r in up.collect()}
    assert got["d", "a"] == 2 and got["d", "r"] == 3 and ("e", "r") not in got
    groups = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "b")], "grp int, node string")
    assert {tuple(r) for r in G.lowest_common(up, groups, G.depths(up, "r")).collect()} == {(1, "a"), (2, "b")}
    ring = links.union(spark.createDataFrame([("p", "q"), ("q", "p")], links.schema))
    with pytest.raises(ValueError):
        G.closure(ring)
    kept = {(r.node, r.ancestor): r.hops for r in G.closure(ring, cycles="keep").collect()}
    assert kept["p", "q"] == 1 and ("p", "p") not in kept and kept["d", "r"] == 3
    assert G.closure(links.limit(0)).count() == 0 and G.root_of(links) == "e2" and G.root_of(links.limit(0)) is None


def test_deep_graph(spark):
    chain = spark.range(200).selectExpr("string(id) as child", "string(id + 1) as parent")
    up = G.closure(chain)
    assert up.count() == 200 * 201 // 2 and up.where("node = '0' and ancestor = '200'").first().hops == 200


def test_split_join(spark):
    left = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', string(id)) as k", "id as v")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), ("none", 4)], "k string, w int")
    counted = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, split_join(left, right, ["k"], counted, how).collect())) == sorted(map(str, left.join(right, "k", how).collect())), how


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None)], "id bigint, e array<float>").repartition(5)
    got = {(r.query_id, r["rank"]): r.base_id for r in L.nearest(df.where("id % 50 = 0"), df, "id", "e", 3).collect()}
    for q in range(0, 500, 50):
        dist = np.sqrt(((v.astype(float) - v[q]) ** 2).sum(1))
        dist[q] = np.inf
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(dist, kind="stable")[:3].tolist()


def test_bootstrap(spark):
    r = E.bootstrap(spark.range(400).withColumn("v", (F.col("id") % 2)), "id", "v", 100).first()
    assert r.low < 0.5 < r.high and abs(r["mean"] - 0.5) < 0.02


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.json", json.dumps({"7": {"pmid": "1", "xml": 1}, "8": {"pmid": "2", "xml": 0}}))
    assert {tuple(r) for r in S.read_zipped_json(spark, str(tmp_path / "a.zip"), "pmid string, xml int").collect()} == {("7", "1", 1), ("8", "2", 0)}
    buf = io.BytesIO()
    np.save(buf, np.arange(6, dtype="float32").reshape(3, 2))
    (tmp_path / "m.npy").write_bytes(buf.getvalue())
    assert [tuple(r.vector) for r in S.read_vectors(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [(0, 1), (2, 3), (4, 5)]
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    got = {r.k: (r.content, r.error) for r in S.fetch(ids, "k", lambda k: k.upper() if k == "a" else 1 / 0, tries=2, wait=0.0).collect()}
    assert got["a"] == ("A", None) and got["b"][0] is None and "division" in got["b"][1]


def test_sections():
    xml = "<article xmlns='u'><sec><title>Methods</title><p>One <i>two</i>.</p><sec><title>Animals</title><p>Rats.</p></sec></sec><sec><title>Results</title><p>No.</p></sec></article>"
    assert from_xml(xml) == [("Methods", "One two."), ("Animals", "Rats.")] and from_xml("<broken") == []
    html = "<h2>2. Materials and Methods</h2><p>A <b>b<p>C</p><script>'</p>x'</script><h3>Animals</h3><p>D</p><h2>Results</h2><p>E</p>"
    assert from_html(html) == [("2. Materials and Methods", "A b"), ("2. Materials and Methods", "C"), ("Animals", "D")]
    pages = {
        "<section data-title='Materials and Methods'><h3>Rats:</h3><p>A</p><div role='paragraph'>B</div><h3>Results</h3><p>C</p></section>": [("Rats", "A"), ("Rats", "B")],
        "<div><h2>Methods</h2><div><h3>Methods</h3><p>A</p></div></div><div><h2>Results</h2><p>C</p></div>": [("Materials and Methods", "A")],
        "<section data-type='materials methods'><section><h3>Rats.</h3><div role='paragraph'>A</div></section></section>": [("Rats", "A")],
        "<div class='NLM_sec NLM_sec_level_1'><span><h2>Methods</h2></span><div class='NLM_sec NLM_sec_level_2'><h4>Rats:</h4><div class='NLM_p'>A</div></div></div>": [("Rats", "A")],
        "<a href='#m7'>Methods</a><div id='m7'><span class='level-4'>Rats</span><p>A</p><p>Results</p><p>C</p></div>": [("Rats", "A")],
        "<h2 class='ejp-article-outline-heading'>Methods</h2><p><strong><em>Rats:</em></strong> A</p><p>B</p><h2 class='ejp-article-outline-heading'>Results</h2><p>C</p>": [("Rats", "Rats: A"), ("Rats", "B")],
        "<h1>Methods</h1><div><p>A</p></div><h2>Results</h2><p>C</p>": [("Methods", "A")],
        "<p>Nothing": [],
        "": [],
    }
    for page, want in pages.items():
        assert from_html(page) == want, page
    assert from_html("<div>" * 5000 + "<h2>Methods</h2><p>A</p>") == [("Methods", "A")]
    assert from_plain("Abstract\n\nx\n\nMethods\n\nOne.\n\nTwo.\n\nResults\n\nNo.") == [("Methods", "One."), ("Methods", "Two.")]
    assert from_plain("Methods: One.") == [("Methods", "One.")]


def test_running_sections():
    text = "Intro. The methods of others failed. 2. Materials and Methods Rats were fed as told. The results were shown later. We saw that our results, too, held. 3. Results They ran."
    assert from_running(text) == [("Materials and Methods", "Materials and Methods Rats were fed as told. The results were shown later. We saw that our results, too, held.")]
    assert from_running("See Smith (methods), according to the methods there. Methods were performed.") == []
    assert from_running("Methodology A. Smith B. wrote; Jones C. Miller D. Adams E. Baker F. Clark G. Evans H. all did") == []
    assert from_running("Methods Rats ran.") == [("Methods", "Methods Rats ran.")] and from_running("") == []


def test_spans(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 9, "c"), (2, None, "d")], "doc int, at int, text string")
    h = spark.createDataFrame([(1, 5, "H"), (1, 7, "I"), (3, 0, "J")], "doc int, at int, text string")
    assert {(r.doc, r.heading, r.text) for r in grouped_by_span(p, h, "doc", "at").collect()} == {(1, None, "a"), (1, "H", "b"), (1, "I", "c"), (2, None, "d")}

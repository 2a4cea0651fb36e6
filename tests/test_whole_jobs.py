"""Queries over every row and value of their tables."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np

from lumenweave.functions.segment import Segmenter
from lumenweave.llm.packing import Search
from lumenweave.operators import classify as K
from lumenweave.operators import linking as L
from lumenweave.operators.unpack import unpack
from lumenweave.plans.catalogue import ORACLES, QUERIES


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def both(spark, folder, name):
    """The query's rows, which its SQL gives too."""
    got = {tuple(r) for r in QUERIES[name](spark, str(folder)).collect()}
    if name in ORACLES:
        db = duckdb.connect()
        for p in folder.iterdir():
            db.execute(f"create view {p.stem} as select * from read_parquet('{p}/*.parquet')")
        assert {tuple(r) for r in db.execute(ORACLES[name]).fetchall()} == got
    return got


def terms(spark, folder):
    save(spark, folder, "ontology_terms", [("m1", "One", []), ("m2", "Two", ["m1"]), ("m3", "Three", ["m1"]), ("m4", "Four", ["m2"])], "id string, name string, parents array<string>")


def test_f55_merges_whole_lists(spark, tmp_path):
    terms(spark, tmp_path)
    rows = [(1, "m2|m3|m2", "Two|Three|two", "one|-1|ONE"), (2, "m1", "One", "One"), (3, None, None, "Four"), (4, "m2", "Two", "unheard of"), (5, None, None, None), (6, "-1|m4", "a|Four", "Two|One")]
    save(spark, tmp_path, "entities_drug_disease_preclin", rows, "entity_row_id bigint, disease_mondo_termid string, disease_mondo_term_norm string, nearest_dataset_parent_label string")
    want = {(1, "m2|m3|m1", "Two|Three|one"), (2, "m1", "One"), (3, "m4", "Four"), (4, "m2|-1", "Two|unheard of"), (5, "", ""), (6, "-1|m4|m2|m1", "a|Four|Two|One")}
    assert both(spark, tmp_path, "f55_merged_lists") == want


def test_a01_collects_every_row(spark, tmp_path):
    rows = [(3, 1, "a <> b", None, None), (1, 1, "a <> b", 4, 2001), (2, 2, "a <> b", 5, None), (4, 2, None, 6, None)]
    save(spark, tmp_path, "translation_table_drug_disease_full", rows, "pair_row_id bigint, batch_id bigint, normalized_key string, preclinical_count int, fda_earliest_year int")
    assert both(spark, tmp_path, "a01_collect_all_lists") == {("a <> b", "1:4,2:5,3:null", 3), (None, "4:6", 1)}


def test_f02_takes_every_document(spark, tmp_path):
    rows = [(1, "Été 1", "fr"), (2, "Größe", "DE"), (3, "Ñandú", None), (4, "à", "sv"), (5, None, "en"), (6, "", "")]
    save(spark, tmp_path, "documents", rows, "doc_id bigint, text string, lang string")
    assert both(spark, tmp_path, "f02_all_without_accents") == {(1, "ete"), (2, "groe"), (3, "nandu"), (4, "a"), (5, None), (6, "")}


def test_g07_takes_groups_of_any_size(spark, tmp_path):
    rows = [("r", []), ("a", ["r"]), *[(f"c{i}", ["a"]) for i in range(7)]]
    save(spark, tmp_path, "ontology_terms", [(f"MONDO:{'9225707' if k == 'r' else k}", [f"MONDO:{'9225707' if p == 'r' else p}" for p in ps]) for k, ps in rows], "id string, parents array<string>")
    cells = [(1, "|".join(f"MONDO:c{i}" for i in range(7))), (2, "MONDO:c3"), (3, "MONDO:c1|-1||MONDO:c2|-1"), (4, "-1"), (5, None), (6, "MONDO:c1|MONDO:a")]
    save(spark, tmp_path, "entities_drug_disease_preclin", cells, "entity_row_id bigint, disease_mondo_termid string")
    assert both(spark, tmp_path, "g07_lowest_common_ancestor") == {(1, "MONDO:a"), (2, "MONDO:c3"), (3, "MONDO:a"), (6, "MONDO:a")}


TEXTS = [(1, "A maze and an open field. Slides were stained. The maze again!"), (2, "Sections examined by light microscope, STAINED."), (3, "Nothing."), (4, None)]


def test_c08_gives_every_domain(spark, tmp_path):
    save(spark, tmp_path, "documents", TEXTS, "doc_id bigint, text string")
    want = {(1, "behavior", 1, "maze|open field test"), (1, "histology", 1, "staining"), (2, "behavior", 0, ""), (2, "histology", 1, "microscopy|section count|staining")}
    assert both(spark, tmp_path, "c08_assay_domains") == want | {(i, x, 0, "") for i in (3, 4) for x in ("behavior", "histology")}


def test_vocabulary_is_a_table(spark):
    rows = [("pain", "Hot Plate; tail flick", "nociception"), ("pain", "plate", "plate test"), ("motor", "rotarod;", "rotarod test")]
    names = K.vocabulary(spark.createDataFrame(rows, "domain string, synonym string, canonical string"))
    assert names == {"motor": {"rotarod": "rotarod test"}, "pain": {"hot plate": "nociception", "tail flick": "nociception", "plate": "plate test"}}
    got = K.assay_domains(spark.createDataFrame([(1, "A hot plate, then a tail flick")], "i int, t string"), ["i"], "t", names)
    assert {(r.domain, *r.names) for r in got.collect()} == {("pain", "nociception"), ("motor",)}


def test_a11_unites_every_domain(spark, tmp_path):
    save(spark, tmp_path, "documents", TEXTS, "doc_id bigint, text string")
    want = {(1, "behavior, histology", "behavior: maze, open field test; histology: staining", "behavior: 0, 2; histology: 1"), (2, "histology", "histology: microscopy, section count, staining", "histology: 0")}
    assert both(spark, tmp_path, "a11_assay_domains") == want


def test_c12_gives_every_mention(spark, tmp_path):
    save(spark, tmp_path, "full_pubmed_filtered_animal_6002827_metadata", [(1, "A model of lorexia, type 2 in Vel-Brown guinea pigs."), (2, None)], "meta_row_id bigint, title string")
    text = "EAE and MPTP-treated mice; hemi-parkinsonian rats, 5xfad and app/ps1 lines. Cuprizone model. A model of x in y z. A model of u in v w."
    save(spark, tmp_path, "documents", [(7, text), (8, "No.")], "doc_id bigint, text string")
    got = both(spark, tmp_path, "c12_model_mentions")
    assert {r[4:] for r in got if r[1] == 1} == {("A model of lorexia, type 2 in Vel-Brown guinea pigs.", "lorexia, type 2", "Vel-Brown")}
    ms, pd, ad = "multiple sclerosis", "Parkinson disease", "Alzheimer disease"
    want = {("EAE", ms), ("MPTP-treated", pd), ("hemi-parkinsonian", pd), ("5xfad", ad), ("app/ps1", ad), ("Cuprizone model", ms), ("A model of x in y z.", "x"), ("A model of u in v w.", "u")}
    assert {r[4:6] for r in got if r[1] == 7} == want and all(text[r[2] : r[3]] == r[4] for r in got if r[1] == 7)


def test_f30_gives_every_age(spark, tmp_path):
    rows = [(1, "Rats of 20 days and 10 weeks; later 2 years, 3 months."), (2, "None."), (3, None), (4, "99999999999 days, then 1 week")]
    save(spark, tmp_path, "documents", rows, "doc_id bigint, text string")
    want = {(1, 1, 2, "young"), (1, 2, 10, "adult"), (1, 3, 104, "aged"), (1, 4, 13, "adult"), (4, 1, None, None), (4, 2, 1, "young")}
    assert both(spark, tmp_path, "f30_every_age") == want


def test_j12_and_j13_lose_no_pair(spark, tmp_path):
    schema = "name string"
    left = spark.createDataFrame([("fvbn",), ("abcdefgh",), ("xy",)], schema)
    right = spark.createDataFrame([("fvb/n",), ("abcd-efg-h",), ("zz",)], schema)
    assert {tuple(r) for r in L.near_strings(left, right, 0.8).collect()} == {("fvbn", "fvb/n", 0.8), ("abcdefgh", "abcd-efg-h", 0.8)}
    save(spark, tmp_path, "translation_table_drug_disease_full", [("Abcdefghijkl ",), ("nothing",), (None,)], "merged_umls_label string")
    names = [("abcdefghijklwxyz", "N"), ("wxyzabcdefghijkl", "Y"), ("abcdefghijzzzz", "Y")]
    save(spark, tmp_path, "umls_concepts", names, "str string, ispref string")
    want = {("abcdefghijkl", "abcdefghijklwxyz", 0.857143), ("abcdefghijkl", "wxyzabcdefghijkl", 0.857143)}
    assert both(spark, tmp_path, "j13_block_ratio") == want


def test_near_blocks_is_exact(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
    left, right = {word() for _ in range(150)}, {word() for _ in range(150)}
    df = lambda x: spark.createDataFrame([(w,) for w in x], "name string")
    want = set()
    for a in left:
        scores = {b: SequenceMatcher(None, a, b).ratio() for b in right}
        want |= {(a, b) for b, r in scores.items() if r >= 0.75 and r == max(scores.values())}
    assert {(r.name, r.match) for r in L.near_blocks(df(left), df(right), 0.75).collect()} == want


def test_p8_tries_every_pair():
    donor, other = [41] + [10] * 32 + [3, 4], [7 - 2] + [1000]
    sizes = donor + other
    search = Search(sizes=np.array(sizes), bins=[list(range(len(donor))), [len(donor), len(donor) + 1]], capacity=1007)
    search._leave(0)
    assert search._step(0) and search.fill[1] == 1007 and {sizes[i] for i in search.bins[1]} == {3, 4, 1000}


def test_p3_covers_long_values_and_unicode_blanks(spark):
    long, bars = "a, b, c, d, e, f, g, h, i, j, k", "1|2|3|4"
    segment = Segmenter([long, bars, "plain"]).segment
    assert list(segment(f"{long}, plain")) == [long, "plain"]
    assert list(segment(f"plain; {bars}")) == ["plain", bars]
    path = "/".join("abcdefghijkl")
    assert list(segment(path)) == [path]
    cells = [(1, "plain\u00a0and\u2003other"), (2, "1.\u00a0plain\u00a02.\u2003other"), (3, "MONDO:1\u2003MONDO:2"), (4, "MONDO:1\u00a0-1")]
    got = unpack(spark.createDataFrame(cells, "id bigint, cell string"), "id", "cell", ["plain", "other"], 2)
    names = ["plain", "other"]
    want = {1: names, 2: names, 3: ["MONDO:1", "MONDO:2"], 4: ["MONDO:1", "-1"]}
    assert {(r.row_id, r.pos, r.item_text) for r in got.collect()} == {(i, k + 1, x) for i, xs in want.items() for k, x in enumerate(xs)}

import os

import pytest
from pyspark.sql import functions as F

from lumenweave.llm.language import declared, fit, from_address, from_markup, identify, mislabelled, units

TEXT = {
    "en": "The animals were kept in cages during the whole study. We asked whether the drug slows the disease in rats. None of them had to be excluded.",
    "de": "Die Tiere wurden während der gesamten Studie in Käfigen gehalten. Wir untersuchten, ob der Wirkstoff die Krankheit verlangsamt. Keines von ihnen wurde ausgeschlossen.",
    "fr": "Les animaux ont été gardés dans des cages pendant toute l'étude. Nous avons demandé si le médicament ralentit la maladie. Aucun d'entre eux n'a été exclu.",
    "es": "Los animales se mantuvieron en jaulas durante todo el estudio. Queríamos saber si el fármaco frena la enfermedad. Ninguno de ellos fue excluido.",
    "it": "Gli animali sono stati tenuti nelle gabbie per tutto lo studio. Volevamo sapere se il farmaco rallenta la malattia. Nessuno di loro è stato escluso.",
    "pt": "Os animais foram mantidos em gaiolas durante todo o estudo. Queríamos saber se o fármaco retarda a doença. Nenhum deles foi excluído.",
}
SAMPLE = [(t, k) for k, t in TEXT.items()] * 5


def test_labels(spark):
    said = [("en-GB", "en"), ("ENGLISH", "en"), (" deu ", "de"), ("pt_BR", "pt"), ("Français", "fr"), ("sv", "other"), ("", None), ("und", None), ("n/a", None), (None, None), ("unknown", None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(said)], "i int, s string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(declared(F.col("s"))).collect()] == [w for _, w in said]


def test_units():
    found = units('A title of three words | First sentence is here now. (cf. “Ein Titel auf Deutsch für Tiere”). <p>Second one is also here.</p>\n\nHeading\n\n1.2 ± 3')
    assert [u[3] for u in found if u[3]] == [True, True]


def test_identify(spark):
    rows = [(1, TEXT["en"], "en"), (2, TEXT["en"], "de"), (3, TEXT["pt"], None), (4, TEXT["en"] + "\n\n" + TEXT["de"], "en"), (5, TEXT["fr"] + " Keines von ihnen wurde ausgeschlossen. " + TEXT["fr"], "fr"), (6, None, None), (7, "", "en"), (8, "1.2 ± 3; 4", None), (9, TEXT["it"].upper(), "es"), (9, TEXT["it"].upper(), "es"), (10, TEXT["es"] * 300, "sv"), (11, "A title in English of the study | " + TEXT["de"], "deu")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("j", F.when(F.col("id") > 3, "j")).withColumn("declared", F.lit(1))
    found = identify(df, "id", "text", "lang", "source", "j", fit(SAMPLE))
    got = sorted((r.row_id, r.true_lang) for r in mislabelled(found).collect())
    assert got == [(2, "en"), (3, "pt"), (4, "de"), (4, "en"), (9, "it"), (9, "it"), (10, "es")]
    assert found.count() == len(rows)
    assert identify(df.limit(0), "id", "text", "lang", "source", "j", fit(SAMPLE)).count() == 0


DUTCH = "De dieren werden tijdens het hele onderzoek in kooien gehouden. Wij wilden weten of het middel de ziekte bij ratten vertraagt. Geen van hen hoefde te worden uitgesloten."


def test_other_languages_are_no_case(spark):
    rows = [(1, DUTCH, "nl"), (2, DUTCH, None), (3, TEXT["de"] + "\n\n" + DUTCH * 3, "de")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("j", F.lit(None).cast("string"))
    found = identify(df, "id", "text", "lang", "source", "j", fit(SAMPLE))
    assert mislabelled(found).collect() == []


def test_markup_and_address(spark):
    said = spark.createDataFrame([("<html lang='de-AT'><p>x</p>", "https://www.uni.ac.at/x"), ("<p>x</p>", "example.com"), ("a < b", "fr"), (None, None), ('<p xml:lang="sv">', "host.com.br:80")], "t string, a string").coalesce(1)
    assert [r[:] for r in said.select(from_markup(F.col("t")), from_address(F.col("a"))).collect()] == [("de", "de"), (None, None), (None, None), (None, None), ("other", "pt")]
    short = "Zzxq wvub klkp mnrt. Zzxq wvub klkp mnrt."
    df = spark.createDataFrame([(1, short, "x.pt"), (2, short, "x.it")], "id bigint, text string, host string").selectExpr("*", "'s' as source", "cast(null as string) as lang", "cast(null as string) as j", "if(id = 1, 'pt', 'it') as said")
    model = fit(SAMPLE)
    model.usual[:] = 0  # nothing is foreign
    for more in ({"address": "host"}, {"markup": "said"}):
        got = identify(df, "id", "text", "lang", "source", "j", model, **more)
        assert {r.row_id: r.segments[0]["lang"] for r in got.collect()} == {1: "pt", 2: "it"}


def test_no_bound_on_quotations_asides_and_titles():
    inner = "Das ist ein langer Satz hier. " * 200
    long = f"One sentence stands here now. (cf. “{inner}”). Another one stands here ({inner.replace('.', ',')}) too."
    assert [u[2][0] for u in units(long) if u[3]] == ["one", "another"]
    title = "word " * 300
    assert units(f"{title}| One sentence stands here now.")[0][2][0] == "one"
    assert len(units("One sentence stands here. And two stand here. Then | three stands here.")) == 3


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    d = spark.read.parquet(path)
    found = identify(d, "doc_id", "text", "lang", "source", "journal_name")
    own = found.where("declared in ('de', 'es', 'fr', 'it', 'pt') and size(segments) = 1")
    right = own.where(F.col("segments")[0]["lang"] == F.col("declared")).count()
    assert right > 0.8 * own.count()  # labels themselves are wrong at times

from pyspark.sql import functions as F

from lumenweave.functions import ages as A
from lumenweave.functions import biology as B
from lumenweave.operators import classify as K


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.coalesce(1).select(column(F.col("x"))).collect()]


def test_normal_ages(spark):
    cases = {"10-week-old": "10 weeks", "<8 – 10 weeks": "8-10 weeks", "~5 days old": "-5 days", "2 year old": "2 years", "8 ‐ 10 weeks": "8-10 weeks", None: None}
    assert one(spark, A.normal_age, *cases) == list(cases.values())


def test_cleaned_ages(spark):
    cases = {
        "P10-P17 days": "10-17 days",
        "3 or 6 months": "3 months, 6 months",
        "14, 21 and 56 days": "14 days, 21 days, 56 days",
        "8 weeks to 10 weeks": "8-10 weeks",
        "AGE: 8 weeks, 20 g ### noise AGE: 8 weeks, adult --- x": "8 weeks, adult",
        "unknown, 3 months": "3 months",
        "unknown": "unknown",
        "20-25 g": "age not specified",
        "": "age not specified",
        None: "age not specified",
    }
    assert one(spark, A.cleaned_ages, *cases) == list(cases.values())


def test_classified_ages(spark):
    cases = {
        "8 weeks, 70 weeks": ("adult, aged", "70 weeks, 8 weeks"),
        "55.26 ± 6.44 weeks": ("adult, aged", "48.82 weeks, 61.70 weeks"),
        "812 weeks": ("adult", "8-12 weeks"),
        "1014 days": ("young", "1 weeks, 2 weeks"),
        "3 months": ("adult", "13 weeks"),
        "2 years": ("aged", "104.0 weeks"),
        "10-week-old": ("adult", "10 weeks"),
        "8 weeks old": ("adult", "8 weeks"),
        "aged": ("aged", "aged"),
        "Adult": ("adult", "adult"),
        "juvenile rats": ("young", "young"),
        "age not specified": ("age not specified", "age not specified"),
        "some time": ("age classification not possible", "some time"),
        None: None,
    }
    got = [tuple(r) if r else None for r in one(spark, A.classified_ages, *cases)]
    assert got == list(cases.values())


def test_resolved_ages(spark):
    cases = [
        ("rats of 8 weeks", "8", "weeks", "8 weeks"),
        ("aged 5–8 weeks", "58", "weeks", "5-8 weeks"),
        ("at (P56) they", "56", "weeks", "56 days"),
        ("Fifty seven-week-old rats", "57", "weeks", "7 weeks"),
        ("a loss of 8 % only", "8", "weeks", "8 weeks"),
        ("nothing", "12", "Months", "12 months"),
        (None, "3", "days", "3 days"),
    ]
    df = spark.createDataFrame(cases, "context string, age string, unit string, want string").coalesce(1)
    for r in df.select("*", A.resolved_age(F.col("context"), F.col("age"), F.col("unit")).alias("got")).collect():
        assert r.got == r.want, r


def test_weekly_ages(spark):
    df = spark.createDataFrame([(1, "8 weeks, 12 weeks", "8 Weeks"), (2, "3-4 weeks", "3-4 weeks"), (3, "8 days", "8 days"), (4, "adult, 9 weeks", "9 weeks"), (5, None, None)], "id int, label string, raw string")
    assert {(r.id, r.age_num, r.age_unit) for r in A.weekly_ages(df, ["id"], "label", "raw").collect()} == {(1, 8, "weeks"), (1, 12, "weeks"), (4, 9, "weeks")}


def test_strain_families(spark):
    cases = {"C57 BL/6J": "C57BL/6", "c57bl-6": "C57BL/6", "Balb/c": "BALB/C", "DBA/2J": "DBA/2", "FVB/N": "FVB/N", "129S1": "129", "CBA/J": "CBA", "Sprague Dawley": "Sprague-Dawley", "Sprague-Dawey": "SpragueDawey", "wistar han": "Wistar", "Long Evans": "Long-Evans", "F344": "Fischer", "Lewis": "Lewis", "Lewiston": "Lewiston", "swiss albino": "Swiss Albino", "B6;129-Tg(X)1": "B6129", "New/Old/J": "New/Old", "not reported": "not reported", None: None}
    assert one(spark, B.strain_family, *cases) == list(cases.values())


def test_numbers_of_lists():
    assert [B.numbers_of(x) for x in ("4, 20", "Four, four", "= 46", "1st, 2nd", "four, none", "", "a hundred", "1,200")] == [[4, 20], [4], [46], [1, 2], None, None, [100], [1200]]


SENTENCES = {
    "Rats were kept here. They were fed.": ["Rats were kept here.", "They were fed."],
    "We gave it i.p. After that they slept well.": ["We gave it i.p. After that they slept well."],
    "It was shown by Smith et al. In rats it fails.": ["It was shown by Smith et al. In rats it fails."],
    "See Fig. 4 for what we saw. Then it was over.": ["See Fig. 4 for what we saw.", "Then it was over."],
    "They ran fast! (as before) and then they slept.": ["They ran fast! (as before) and then they slept."],
    "It was cut. of the brain nothing was left.": ["It was cut. of the brain nothing was left."],
    "A. B. Smith saw that rats run.": ["A. B. Smith saw that rats run."],
    "Ther. [20] H.S. Panitch was the first to see it.": [],
    "245 (1988) 574580. Rats were kept here too.": ["Rats were kept here too."],
    "68 1981 19 25 was the volume of it all. Is it so?  We think that it is.": ["Is it so?", "We think that it is."],
    "": [],
}


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES)] + [(99, None)], "id int, text string").withColumn("sentence_id", F.lit("clash"))
    got = {}
    for r in K.sentences(df, "id", "text").orderBy("id", "sentence_id").collect():
        got.setdefault(r.id, []).append(r.sentence)
    assert [got.get(i, []) for i in range(len(SENTENCES))] == list(SENTENCES.values()) and 99 not in got


def test_roots_and_stages(spark):
    cases = {"ataxia, type 2": ("ataxia", "2"), "ataxia type IV": ("ataxia", "IV"), "ataxia 1b and": ("ataxia", "1b"), "ataxia X": ("ataxia", "X"), "disease 2": (None, None), "chromosome deletion 5": (None, None), "ataxia": (None, None), "glycogen storage": (None, None), None: (None, None)}
    assert [tuple(r) for r in one(spark, B.root_and_stage, *cases)] == list(cases.values())

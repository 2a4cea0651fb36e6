"""Entities as tools and annotators give them: cleaned, found in texts, placed and scored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.cells import let, tokens
from lumenweave.operators.evaluate import prf
from lumenweave.operators.unpack import MOST_KNOWN

# Words of mechanisms, which name no drug, and names that mean the same drug.
MECHANISMS = ("antibody", "channel", "receptor", "modulator", "blocker", "agonist", "antagonis", "anti-", "inhibitor")
SAME_DRUG = {
    "Fingolimod": "fty720-c2|fingolimod-1 phosphate",
    "vitamin D3": "1,25-dihydroxyvitamin d|1alpha,25-dihydroxyvitamin d|vitamin d|vitamin d3|calcitriol|cholecalciferol",
    "beta 1 Interferon": "beta interferon|interferon beta (recombinant)",
}
# How countries are written besides their own name; more come as a table.
COUNTRIES = {
    "United States": "usa|u.s.a|u.s.a.|us|u.s.|united states|united states of america",
    "United Kingdom": "uk|u.k.|united kingdom|england|scotland|wales|northern ireland",
    "Netherlands": "netherlands|the netherlands",
    "Germany": "germany|deutschland",
    "Austria": "austria|österreich",
    "Switzerland": "switzerland|suisse|schweiz|svizzera",
    "Spain": "spain|españa",
    "Brazil": "brazil|brasil",
    "China": "china|中国|hong kong|macau|macao",
    "Japan": "japan|日本|nippon",
}
DEPARTMENT = r"(?i)^\s*\d*\s*(?:departments?|divisions?|institutes?|clinic|hospital|center|centre|laboratory|lab|school|college)\b[^,]*\.?\s*$"
SHORT_NAME = r"^[A-Za-zÀ-ÖØ-öø-ÿ'’\-\s.]{1,100}$"


def is_junk(token: Column) -> Column:
    """Whether a token is no name: one character or less, only signs, only a number with signs, or ``#`` without a letter."""
    t = F.btrim(F.btrim(F.btrim(token), F.lit('"')), F.lit("'"))
    return let(F.btrim(t), lambda x: (F.length(x) < 2) | x.rlike(r"^[()\[\]{}'\",.#\s\-_+=]+$") | x.rlike(r"^[#\s'\"()+\-]*\d+['\")\s,]*$") | (x.startswith("#") & ~x.rlike("[A-Za-z]")))


def clean_drugs(cell: Column) -> Column:
    """A pipe cell of drug names without junk, mechanisms and names of odd characters, same drugs under one name, each once and sorted; the
    cell itself if nothing is left. Null stays null."""
    bare = lambda t: F.btrim(F.btrim(F.btrim(F.btrim(t), F.lit('"')), F.lit("'")))
    canonical = F.create_map(*[F.lit(x) for name, others in SAME_DRUG.items() for other in others.split("|") for x in (other, name)])
    mechanism = "|".join(MECHANISMS)
    named = F.transform(F.filter(F.transform(F.split(cell, r"\|"), bare), lambda t: ~is_junk(t) & ~F.lower(t).rlike(mechanism)), lambda t: F.coalesce(canonical[F.lower(t)], t))
    kept = F.array_sort(F.array_distinct(F.filter(named, lambda t: t.rlike(r"^[A-Za-z0-9\-\s()]+$"))))
    return let(F.array_join(kept, "|"), lambda x: F.when(x != "", x).otherwise(cell))


def by_type(annotations: Column, kind: str, abbreviations: Column) -> Column:
    """Sorted pipe cell of the entities of a kind, of an array of structs (kind, entity): two characters at least, no word pieces (``##``),
    abbreviations (MAP of the document, as written or in capitals) replaced, lower case, each once."""
    own = F.filter(annotations, lambda a: (a["kind"] == kind) & ~a["entity"].startswith("##") & (F.length(a["entity"]) > 1))
    long = lambda a: F.coalesce(abbreviations[a["entity"]], abbreviations[F.upper(a["entity"])], a["entity"])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda a: F.lower(long(a))))), "|")


def in_title(title: Column, spans: Column, kind: str, inside: bool) -> Column:
    """Texts of the spans (start, stop, kind, text) of a kind whose places name them in the title, or those that don't; each once, in order."""
    there = lambda s: (s["start"] >= 0) & (s["start"] < s["stop"]) & (s["stop"] <= F.length(title)) & (F.lower(F.substr(title, s["start"] + 1, s["stop"] - s["start"])) == F.lower(s["text"]))
    hit = lambda s: F.coalesce(there(s), F.lit(False))
    return F.array_distinct(F.transform(F.filter(spans, lambda s: (s["kind"] == kind) & (hit(s) if inside else ~hit(s))), lambda s: s["text"]))


def country_of(text: Column, names: dict[str, str] | None = None) -> Column:
    """The last country that a text names as a whole word; null without one. ``names``: ways of writing, parted by ``|``, by country."""
    ways = {way: name for name, others in (names or COUNTRIES).items() for way in others.split("|")}
    pattern = r"(?iU)(?<![\p{L}\p{N}])(" + "|".join(r"\Q" + w + r"\E" for w in sorted(ways, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}])"
    lookup = F.create_map(*[F.lit(x) for kv in ways.items() for x in kv])
    return lookup[F.lower(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))]


def skip_affiliation(text: Column, country: Column, most_words: int = 4) -> Column:
    """Whether an affiliation says too little to be placed: none at all, a department only, or one short name; not if it names a country."""
    bare = F.trim(text)
    short = ~F.contains(bare, F.lit(",")) & (F.size(F.split(bare, r"\s+")) <= most_words) & bare.rlike(SHORT_NAME)
    return F.coalesce(bare == "", F.lit(True)) | (country.isNull() & (bare.rlike(DEPARTMENT) | short))


def first_contained(df: DataFrame, text: str, terms: DataFrame, most: int = MOST_KNOWN) -> DataFrame:
    """``df`` with ``rank`` and ``term`` of the first of ``terms`` (rank, term) that the lower-cased text contains anywhere; null if none.

    An automaton over all terms reads each text once, however many terms there are. The dictionary is sent to every worker, so its size is
    checked: more than ``most`` terms raise ValueError. Null texts have none; of terms with one rank the least counts.
    """
    rows = terms.select(F.col("rank").cast("bigint"), F.lower("term").alias("term")).where("term <> ''").groupBy("term").agg(F.min("rank").alias("rank")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    known = [(r["rank"], r["term"]) for r in rows]

    @F.pandas_udf("struct<rank:bigint,term:string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for own in known:
            automaton.add_word(own[1], own)
        if known:
            automaton.make_automaton()
        for batch in batches:
            got = [min((own for _, own in automaton.iter(t)), default=(None, None)) if t and known else (None, None) for t in batch]
            yield pd.DataFrame({"rank": pd.array([g[0] for g in got], "Int64"), "term": [g[1] for g in got]})

    return df.withColumn("__hit", find(F.lower(text))).withColumn("rank", F.col("__hit.rank")).withColumn("term", F.col("__hit.term")).drop("__hit")


def longest_first(terms: DataFrame, least: int) -> DataFrame:
    """Terms of more than ``least`` characters, ranked so that longer ones come first."""
    return terms.where(F.length("term") > least).select((-F.length("term")).alias("rank"), "term")


def entity_scores(df: DataFrame, truth: str, said: str, least: float = 0.6) -> DataFrame:
    """Precision, recall and F1 over the entities of pipe cells, exact and partial: match, tp, fp, fn and scores.

    Of each row the union of true and said entities (more than two characters, lower case) is judged: exactly, by membership; partially,
    by a matching-blocks ratio of at least ``least`` with any entity of the side. Rows that lack one side count too.
    """
    own = lambda c: F.array_distinct(F.filter(F.transform(tokens(F.col(c)), lambda x: F.lower(x)), lambda x: F.length(x) > 2))
    rows = df.select(own(truth).alias("t"), own(said).alias("s"))

    @F.pandas_udf("struct<tp:int,fp:int,fn:int>")
    def partial(true: pd.Series, given: pd.Series) -> pd.DataFrame:
        def near(x: str, others: Sequence[str]) -> bool:
            return any(x == o or SequenceMatcher(None, x, o).ratio() >= least for o in others)

        out = []
        for t, s in zip(true, given):
            every = [(near(x, t), near(x, s)) for x in {*t, *s}]
            out.append((sum(a and b for a, b in every), sum(b and not a for a, b in every), sum(a and not b for a, b in every)))
        return pd.DataFrame(out, columns=["tp", "fp", "fn"])

    exact = F.struct(F.size(F.array_intersect("t", "s")).alias("tp"), F.size(F.array_except("s", "t")).alias("fp"), F.size(F.array_except("t", "s")).alias("fn"))
    same = (F.size("t") == 0) | (F.size("s") == 0) | (F.array_sort("t") == F.array_sort("s"))
    loose = F.coalesce(partial(F.when(~same, F.col("t")).otherwise(F.array().cast("array<string>")), F.when(~same, F.col("s")).otherwise(F.array().cast("array<string>"))), exact)
    counted = rows.select(F.posexplode(F.array(exact, F.when(same, exact).otherwise(loose))).alias("k", "x")).select(F.when(F.col("k") == 0, "exact").otherwise("partial").alias("match"), "x.*")
    g = counted.groupBy("match").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return g.select("match", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))

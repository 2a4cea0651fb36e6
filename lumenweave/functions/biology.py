"""Ages, numbers and names as they are written in articles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweave.functions.cells import let
from lumenweave.functions.text import squeeze

# English number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}


def weeks(number: Column, unit: Column) -> Column:
    """Weeks of an age: days by sevens, months by 4.345 cut, years by 52."""
    u = F.lower(unit)
    return F.when(u.startswith("day"), F.floor(number / 7)).when(u.startswith("week") | u.startswith("wk"), number).when(u.startswith("month"), F.floor(number * 4.345)).when(u.startswith("year") | u.startswith("yr"), number * 52).cast("int")


def age_class(w: Column) -> Column:
    return F.when(w < 8, "young").when(w < 60, "adult").when(w >= 60, "aged")


def plus_minus(text: Column) -> Column:
    """``m ± s unit`` as its range with two decimals, not below 0; ``+/-`` is ``±``; a unit further on counts; other text stays."""
    t = F.translate(text, "\u2009\xa0", "  ")
    p = r"(\d+(?:\.\d+)?)\s*(?:±|\+/?-)\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)"
    m, s, near = (F.regexp_extract(t, p, i) for i in (1, 2, 3))
    u = F.lower(F.when(near != "", near).otherwise(F.regexp_extract(t, r"(?i)\b(weeks?|wks?|months?|mos?|days?|yrs?|years?)\b", 1)))
    long = F.when(u.rlike("^(?:wks?|weeks?)$"), "weeks").when(u.rlike("^(?:mos?|months?)$"), "months").when(u.rlike("^(?:yrs?|years?)$"), "years").when(u.rlike("^(?:d|days?)$"), "days").otherwise(u)
    lo = F.greatest(F.lit(0.0), m.try_cast("double") - s.try_cast("double"))
    hi = m.try_cast("double") + s.try_cast("double")
    unit = F.when(long != "", F.concat(F.lit(" "), long)).otherwise("")
    return F.when(m != "", F.concat(F.format_string("%.2f", lo), unit, F.lit(", "), F.format_string("%.2f", hi), unit)).otherwise(text)


def lost_dash(w: Column) -> Column:
    """Ages above 150 weeks as the range whose dash was lost: ``812`` is ``8-12``, ``1014`` is ``10-14``."""
    s = w.cast("string")
    return F.when((w > 150) & (F.length(s) == 3), F.concat(F.substring(s, 1, 1), F.lit("-"), F.substring(s, 2, 9))).when(w > 150, F.concat(F.substring(s, 1, 2), F.lit("-"), F.substring(s, 3, 9))).otherwise(s)


def repaired(text: Column) -> Column:
    """Blanks around hyphens, slashes, brackets and before 's taken out; dashes made one."""
    t = F.translate(text, "–—−‐", "----")
    t = F.regexp_replace(t, r"\s*([-/])\s*", "$1")
    t = F.regexp_replace(t, r"\(\s+", "(")
    return F.regexp_replace(F.regexp_replace(t, r"\s+\)", ")"), r"\s+'s\b", "'s")


def titled(text: Column) -> Column:
    """Each run of letters with a capital and small letters after it (``C57BL/6`` is ``C57Bl/6``); word pieces (``##``) join what is before."""
    runs = F.split(F.regexp_replace(text, r"\s*##", ""), r"(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def filtered_tags(tags: Column, kinds: list[str]) -> Column:
    """Tags with their alternatives (``B-DRUG|I-DRUG``) cut down to these kinds, each once; of one kind ``B`` goes before ``I``; ``O`` if none is left."""
    allowed = [f"{p}-{k}" for k in kinds for p in "BI"]

    def one(tag: Column) -> Column:
        own = F.array_intersect(F.array_distinct(F.transform(F.split(F.upper(tag), r"\|"), lambda x: F.trim(x))), F.array(*map(F.lit, allowed)))
        return let(own, lambda xs: let(F.array_join(F.array_sort(F.filter(xs, lambda x: x.startswith("B-") | ~F.array_contains(xs, F.concat(F.lit("B-"), F.substring(x, 3, 100))))), "|"), lambda t: F.when(t == "", "O").otherwise(t)))

    return F.transform(tags, one)


def singular(text: Column) -> Column:
    """Without the plural s of the last word, unless it ends in ss, us or is or is short."""
    return F.when((F.length(text) > 3) & text.rlike(r"[^siu]s$"), F.regexp_replace(text, r"s$", "")).otherwise(text)


# What ends a name as its stage, and names that are no root.
STAGE = r"(?:\d+[A-Za-z]?|[IVXivx]+|[A-Za-z]|[A-Za-z]{1,2}\d{1,2}[A-Za-z]?)"
GENERIC = ("disease", "syndrome", "disorder", "deficiency", "type", "form", "group", "stage", "grade", "class")


def root_and_stage(name: Column) -> Column:
    """``root[,] [type] stage`` as STRUCT<root, stage>: a stage is a number, a roman numeral, one letter or a short code.

    Both are null where there is none, where the root is a general word, and for names of chromosomes. ``and`` or ``or`` at the end goes.
    """
    t = F.regexp_replace(F.trim(name), r"(?i)[\s,]+(?:and|or)$", "")
    p = rf"(?i)^(.+?),?(?:\s+type)?\s+({STAGE})$"
    root, stage = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    good = (root != "") & ~F.lower(root).isin(*GENERIC) & ~F.lower(t).contains("chromosome")
    return F.struct(F.when(good, root).alias("root"), F.when(good, stage).alias("stage"))


def strain_key(text: Column) -> Column:
    """Spelling of a strain apart from case, blanks, hyphens, slashes, a trailing J and the animal's name."""
    t = F.regexp_replace(F.lower(squeeze(text)), r"\s+(?:mice|mouse|rats?)$", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s/\-]", ""), r"(?<=\w)j$", "")


# Families of strains by how their names begin, without blanks and hyphens; $1 is the first group.
FAMILIES = {
    r"^C57/?B?L?/?(\d+)": "C57BL/$1",
    r"^BALB/?C(?![A-Z0-9_])": "BALB/C",
    r"^DBA/?(\d+)": "DBA/$1",
    r"^FVB": "FVB/N",
    r"^129": "129",
    r"^CBA(?:/[A-Z0-9]+)?$": "CBA",
    r"^NOD(?:/[A-Z0-9]+)?$": "NOD",
    r"^C3H(?:/[A-Z0-9]+)?$": "C3H",
    r"^SJL(?:/[A-Z0-9]*)?$": "SJL",
    r"^SPRAGUE[A-Z]{0,6}DAWLE?Y": "Sprague-Dawley",
    r"^WISTAR": "Wistar",
    r"^LONG[A-Z]{0,6}EVA[NS]{1,2}": "Long-Evans",
    r"^(?:FISCHE?R?344|F344)": "Fischer",
    r"^LEW(?:IS$|(?![A-Z]))": "Lewis",
    r"^SWISSALBINO": "Swiss Albino",
}
NO_STRAIN = ("NOT REPORTED", "UNLABELED", "NAN", "NONE", "OTHER")


def strain_family(text: Column) -> Column:
    """The family of a strain, however it is written: the first of ``FAMILIES`` that fits; else the name without blanks, brackets, transgenes
    and a substrain's letters, its first two parts if it has a slash. Placeholders stay."""
    bare = lambda t, letters: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?is)-?Tg\([^)]*\).*", ""), r"\([^)]*\)", ""), rf"[^{letters}0-9/\s_-]", " "), r"[\s_-]+", ""), "/+", "/")
    name = F.trim(text)
    key = bare(F.upper(name), "A-Z")
    out = F.when(F.upper(name).isin(*NO_STRAIN), name)
    for pattern, family in FAMILIES.items():
        told = F.concat(F.lit(family[:-2]), F.regexp_extract(key, pattern, 1)) if family.endswith("$1") else F.lit(family)
        out = out.when(key.rlike(pattern), told)
    rest = F.regexp_replace(bare(name, "A-Za-z"), r"/[A-Za-z]+$", "")
    two = F.regexp_extract(rest, r"^([^/]+/[^/]+)", 1)
    return out.when(two != "", two).otherwise(rest)


def spelled_number(text: str) -> float | None:
    """A number in digits or words, or both (``one hundred and 62``); null if there is none."""
    words = re.findall(r"\d+(?:\.\d+)?|[a-z]+", text.lower().replace(",", "").replace("-", " "))
    total, part, seen = 0.0, 0.0, False
    for w in words:
        if w in UNITS or w in TENS or w[0].isdigit():
            part += UNITS.get(w, TENS.get(w)) if not w[0].isdigit() else float(w)
            seen = True
        elif w in SCALES:
            part, seen = (part or 1) * SCALES[w], True
            if SCALES[w] > 100:
                total, part = total + part, 0.0
        elif w == "and" and seen:
            continue
        elif seen:
            break
    return total + part if seen else None


def numbers_of(text: str) -> list[float] | None:
    """The numbers of a list parted by commas, once if all are the same; null unless each piece is one.

    Ordinals (``1st``), words before (``about``, ``n =``) and after (``animals``, ``kg``) and signs don't matter.
    """
    t = re.sub(r"^[^0-9a-z]+|^an? (?=\w)", "", re.sub(r"(\d)(?:st|nd|rd|th)\b", r"\1", text.strip().lower()))
    found = [spelled_number(p) for p in re.split(r",(?!\d{3}(?:\D|$))", t)]
    if not found or None in found:
        return None
    return found[:1] if len(set(found)) == 1 else found


def number_of(text: Column) -> Column:
    """The first number of a text. Plain digits stay in the JVM."""

    @F.pandas_udf("double")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else spelled_number(t) for t in b], dtype="float64")

    plain = F.regexp_extract(text, r"^[^\p{L}\d]*(?:n\s*=\s*)?(\d+)\s*$", 1)
    return F.coalesce(plain.try_cast("double"), parse(F.when(plain == "", text)))

"""Ages as articles and annotators write them: cleaned, classified, held against their text. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.biology import age_class, plus_minus
from lumenweave.functions.cells import let

# Units of age, signs that stand for a dash or for "about", weights, and phrases that say nothing.
UNIT = r"(?:weeks?|months?|days?|years?)"
SHORT_UNIT = r"(?:weeks?|wks?|months?|mos?|days?)"
DASHES = "–—~‐‑‒―−"
NO_SIGNS = "<>∼〜～⁓∽≈≅"
WEIGHT = r"(?i)\b\d*\.?\d+\s*[-–]?\s*\d*\s*(?:g|gram|grams|kg|kilogram|kilograms)\b"
NOTHING = r"(?i)^(?:age\s*)?(?:not specified|unknown|unspecified)$"
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
NOT_POSSIBLE, NOT_SPECIFIED = "age classification not possible", "age not specified"
WEEKS_AT_MOST, DAYS_AT_MOST = 150, 1000


def normal_age(text: Column) -> Column:
    """``<8 week - old`` and the like in one spelling: no signs, one dash without blanks, ``weeks`` for ``-week-old``."""
    t = F.translate(text, DASHES + NO_SIGNS, "-" * len(DASHES))
    t = F.regexp_replace(t, r"\s*-\s*", "-")
    t = F.regexp_replace(t, r"(years?|days?)[ -]old", "$1")
    t = F.regexp_replace(t, r"(\d)[ -]?(year|day)\b", "$1 $2s")
    return F.regexp_replace(t, r"(\d)[ -]weeks?[ -]old", "$1 weeks")


def cleaned_ages(text: Column) -> Column:
    """A list of ages in one form, joined by ``, ``: ``P10-P17 days`` is ``10-17 days``, ``3 or 6 months`` is ``3 months, 6 months``.

    Only what follows ``AGE:`` counts if that is said; a unit at the end holds for bare numbers; weights go; phrases that say nothing stay
    only alone. Each age once, in order. Null and lists without an age are ``age not specified``.
    """
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"[\n\t]", " ")), r"\bP(?=\d)", "")
    unit = F.lower(F.regexp_extract(t, rf"(?i)\b({UNIT})$", 1))
    t = F.regexp_replace(t, r"(?i)\s+(?:and|or)\s+", " , ")
    t = F.regexp_replace(t, rf"(?i)(\d+)\s*({UNIT})\s+to\s+(\d+)\s*{UNIT}", "$1-$3 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)(\d+)\s+to\s+(\d+)", "$1-$2"), r"\s*[-–]\s*", "-")
    segments = F.regexp_extract_all(t, F.lit(r"(?i)AGE:\s*(.*?)\s*(?=AGE:|$|###|---)"), F.lit(1))
    every = F.split(let(segments, lambda x: F.when(F.size(x) > 0, F.array_join(x, ","))), ",")
    parts = lambda x: F.filter(F.transform(F.coalesce(every, F.split(x, ",")), lambda p: F.trim(p)), lambda p: p != "")
    whole = let(unit, lambda u: F.transform(let(t, parts), lambda p: F.when((u != "") & p.rlike(r"^\d+(?:-\d+)?$"), F.concat_ws(" ", p, u)).otherwise(p)))
    kept = F.filter(whole, lambda p: ~p.rlike(WEIGHT))
    told = let(kept, lambda x: let(F.filter(x, lambda p: ~p.rlike(NOTHING)), lambda y: F.when(F.size(y) > 0, y).otherwise(x)))
    return let(F.array_join(F.array_distinct(told), ", "), lambda x: F.when(x != "", x).otherwise(NOT_SPECIFIED))


def _lost_dash(number: Column, head: Column) -> Column:
    return F.concat(F.left(number, head), F.lit("-"), F.substr(number, head + 1))


def _read_age(piece: Column) -> Column:
    """One age: STRUCT<classes, ages>, both empty where it can't be read."""
    p = F.when(piece.rlike(r"^\S+ \S+$"), piece).otherwise(normal_age(piece))
    cut = let(p, lambda x: F.struct(normal_age(F.regexp_extract(x, r"^(\S+) (\S+)$", 1)).alias("number"), F.regexp_extract(x, r"^(\S+) (\S+)$", 2).alias("unit")))
    none = F.array().cast("array<string>")

    def repaired(x: Column) -> Column:
        number, unit, single = x["number"], x["unit"], x["number"].try_cast("double")
        out = (
            F.when((unit == "weeks") & (single > WEEKS_AT_MOST), _lost_dash(number, F.when(F.length(number) == 3, 1).otherwise(2)))
            .when((unit == "days") & (single > DAYS_AT_MOST), _lost_dash(number, F.lit(2)))
            .otherwise(number)
        )
        fits = number.rlike(r"^[\d.\s-]+$") & (single.isNotNull() | F.contains(number, F.lit("-")))
        return F.struct(out.alias("number"), unit.alias("unit"), fits.alias("fits"))

    def weeks(x: Column) -> Column:
        unit = x["unit"]
        ends = F.filter(F.transform(F.split(x["number"], "-"), lambda e: F.trim(e).try_cast("double")), lambda e: e.isNotNull())
        one = lambda e: F.when(unit == "weeks", e).when(unit.isin("days", "day", "d"), F.floor(e / 7)).when(unit.isin("months", "month", "mo"), F.floor(e * 4.345)).when(unit.isin("years", "year"), e * 52)
        return F.struct(x["number"].alias("number"), unit.alias("unit"), x["fits"].alias("fits"), F.filter(F.transform(ends, one), lambda e: e.isNotNull()).alias("weeks"))

    def told(x: Column) -> Column:
        years = x["unit"].isin("years", "year")
        in_weeks = F.transform(x["weeks"], lambda e: F.concat(F.when(years, e.cast("string")).otherwise(e.cast("bigint").cast("string")), F.lit(" weeks")))
        ages = F.when(x["unit"] == "weeks", F.array(F.concat(x["number"], F.lit(" weeks")))).otherwise(in_weeks)
        return F.struct(F.when(x["fits"], F.transform(x["weeks"], age_class)).otherwise(none).alias("classes"), F.when(x["fits"], ages).otherwise(none).alias("ages"))

    return let(let(let(cut, repaired), weeks), told)


def classified_ages(text: Column) -> Column:
    """A list of ages as STRUCT<classes, ages>: young, adult and aged, and the ages in weeks; each once, sorted and joined by ``, ``.

    ``mean ± deviation`` is its range; a week above 150 and a day above 1,000 has lost its dash. Words such as ``juvenile`` or ``aged`` speak
    where there is no number. What can't be read is left out; without any age the classes say so, and the ages are the text.
    """
    same = lambda c, a: F.struct(F.array(F.lit(c)).alias("classes"), F.array(F.lit(a)).alias("ages"))

    def one(raw: Column) -> Column:
        p = F.trim(raw)
        word = ~p.rlike(r"\d")
        none = F.struct(F.array().cast("array<string>").alias("classes"), F.array().cast("array<string>").alias("ages"))
        return (
            F.when(p.isin("adult", "young adult"), same("adult", "adult"))
            .when(p == NOT_SPECIFIED, none)
            .when(p.rlike("juvenile|neonatal|postnatal day"), same("young", "young"))
            .when(word & p.rlike("aged|old"), same("aged", "aged"))
            .otherwise(_read_age(p))
        )

    def joined(read: Column, field: str, default: Column) -> Column:
        every = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(read, lambda r: r[field])))), ", ")
        return let(every, lambda x: F.when(x == "", default).otherwise(x))

    def whole(t: Column) -> Column:
        said = let(F.transform(F.split(t, ","), one), lambda read: F.struct(joined(read, "classes", F.lit(NOT_POSSIBLE)).alias("classes"), joined(read, "ages", t).alias("ages")))
        nothing = F.struct(F.lit(NOT_SPECIFIED).alias("classes"), F.lit(NOT_SPECIFIED).alias("ages"))
        return F.when(t == NOT_SPECIFIED, nothing).when(t.isNotNull(), said)

    return let(let(F.lower(F.trim(text)), plus_minus), whole)


def weekly_ages(df: DataFrame, keys: list[str], label: str, raw: str, unit: str = "weeks") -> DataFrame:
    """Single ages of rows that speak of weeks (or another ``unit``) and give no range: keys, age_str, age_num, age_unit. Pieces without a number are left out."""
    rows = df.where(~F.col(label).rlike(r"\d+\s*[-–]\s*\d+") & F.lower(raw).contains(unit))
    flat = rows.select(*keys, F.explode(F.split(label, ",")).alias("x")).select(*keys, F.trim("x").alias("age_str"))
    cut = flat.select("*", F.regexp_extract("age_str", r"^(\S+)", 1).try_cast("double").alias("age_num"), F.lower(F.regexp_extract("age_str", r"^\S+\s+(.*)$", 1)).alias("age_unit"))
    return cut.where("age_num is not null")


def resolved_age(context: Column, age: Column, unit: Column) -> Column:
    """An age held against its text: kept where the text has it; ``58`` is ``5-8`` where it has that; days where it has ``P58``; one digit where
    it has that as a word before ``-week-old``; else kept. ``age`` is digits, maybe with a point."""
    a = F.regexp_replace(age, r"\.", "[.]")
    has = lambda *parts: F.coalesce(F.rlike(context, F.concat(F.lit("(?i)"), *[x if isinstance(x, Column) else F.lit(x) for x in parts])), F.lit(False))
    kept = has(r"\b", a, r"\b(?!\s*[%\w])") | has(r"\b", a, rf"\s*{SHORT_UNIT}\b(?!\s*%)") | has(r"\b", a, rf"[-\s]?{SHORT_UNIT}[-\s]?old\b(?!\s*%)")
    first, second = F.left(age, F.lit(1)), F.right(age, F.lit(1))
    split = age.rlike(r"^\d\d$") & has(r"\b", first, r"\s*(?:to|-|–|—)\s*", second, rf"\s*{SHORT_UNIT}?\b")
    in_days = F.coalesce(F.rlike(context, F.concat(F.lit(r"\bP"), a, F.lit(r"(?=[)\s,.])"))), F.lit(False)) & age.rlike(r"^\d{1,3}$")
    words = F.create_map(*[F.lit(x) for i, w in enumerate(DIGITS) if i for x in (str(i), w)])
    spelled = F.filter(F.split(F.when(age.rlike(r"^\d+$"), age).otherwise(""), ""), lambda d: F.coalesce(F.rlike(context, F.concat(F.lit(r"(?i)\b"), words[d], F.lit(r"-week-old\b"))), F.lit(False)))
    out = F.when(kept, age).when(split, F.concat(first, F.lit("-"), second)).when(in_days, age).when(F.size(spelled) > 0, F.get(spelled, F.lit(0))).otherwise(age)
    return F.concat_ws(" ", out, F.when(~kept & ~split & in_days, F.lit("days")).otherwise(F.lower(F.trim(unit))))

"""Column expressions for text and ids. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode white space character, as Python's str.isspace has them.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: The same characters, one after the other.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(SPACES))


def squeeze(x: Column) -> Column:
    """Each run of white space one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def term(x: Column) -> Column:
    """Lower case, each run of white space one blank, ends trimmed."""
    return squeeze(F.lower(x))


def label(x: Column) -> Column:
    """A label cell with one value as a term; null, blank, ``nan`` and ``-1`` give null."""
    t = term(x)
    return F.when(~t.isin("", "nan", "-1"), t)


def article(x: Column) -> Column:
    """The number that an article id spells, as BIGINT.

    White space, leading zeros, ``.0``, a ``PMID`` prefix, thousands commas, exponents and full-width digits don't matter.
    Null, blank and text that spells no number give null. A number above 18 digits gets a negative stand-in, a hash of
    its digits, so that equal numbers still agree.
    """
    # One pass of each pattern: deeper nesting would repeat the whole tree in the generated code.
    t = F.regexp_replace(F.translate(x, "０１２３４５６７８９", "0123456789"), r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    plain = F.regexp_extract(t, rf"(?i)^{SPACE}*(?:pubmed|pmid)?{SPACE}*(?:id)?{SPACE}*[:#=]?{SPACE}*\+?0*(\d+?)(?:\.0*)?{SPACE}*$", 1)
    power = F.when(x.rlike(rf"^{SPACE}*\d(?:\.\d+)?[eE]\+?\d\d?{SPACE}*$"), strip(x).try_cast("double").try_cast("bigint"))
    slow = F.coalesce(plain.try_cast("bigint"), power, F.when(F.length(plain) > 18, -F.abs(F.shiftright(F.xxhash64(plain), 1)) - 1))
    return F.when(x.rlike(r"^\d{1,18}$"), x.try_cast("bigint")).otherwise(slow)


def without_accents(x: Column) -> Column:
    """Latin letters without their accents; other characters stay."""
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    fancy = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    return F.translate(x, fancy + fancy.upper().replace("Ÿ", "Ÿ"), plain + plain.upper())

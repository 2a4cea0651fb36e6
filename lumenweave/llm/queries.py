"""Queries of this subpackage, over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.text import article
from lumenweave.llm import cooccurrence
from lumenweave.llm.chunking import split_oversized
from lumenweave.llm.language import identify, mislabelled
from lumenweave.llm.packing import pack, summary
from lumenweave.llm.split_overlap import SplitOverlap
from lumenweave.llm.term_counts import TermCounts, records
from lumenweave.llm.tokenizing import encode
from lumenweave.plans.training import ENTITIES, disease_names, drug_names
from lumenweave.session import fresh_path, table

NER = "drug_disease_ner"
TRANSLATION = "translation_table_drug_disease_full"


def _fields(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {"merged_mondo_label": disease_names(spark, sf_dir), "merged_umls_label": drug_names(spark, sf_dir)}


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, ENTITIES).select(article(F.col("pmid")).alias("article"), "merged_mondo_label", "merged_umls_label", "loaded_at")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, articles and mark of every disease and drug term: a state built by deltas, the rows of all loads but the last year's first.

    The state is new for each run, as the tables of a run are. One kept from run to run takes the later deltas alone.
    """
    rows, fields = _entities(spark, sf_dir), _fields(spark, sf_dir)
    last = rows.agg(F.max(F.year("loaded_at")).alias("y"))  # one row
    split = rows.crossJoin(F.broadcast(last)).withColumn("late", F.coalesce(F.year("loaded_at") >= F.col("y"), F.lit(True)))
    kept = TermCounts(spark, fresh_path(spark, "term-counts")).apply(records(split.where("not late"), "article", fields), "base")
    return kept.apply(records(split.where("late"), "article", fields), "last year").counts()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_counts(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by three deltas: rows before 2022, the later ones, then rows of 2020 taken out and put back; one comes twice."""
    rows, fields = _entities(spark, sf_dir), _fields(spark, sf_dir)
    late, mid = F.coalesce(F.year("loaded_at") >= 2022, F.lit(True)), F.coalesce(F.year("loaded_at") == 2020, F.lit(False))
    kept = TermCounts(spark, fresh_path(spark, "term-counts")).apply(records(rows.where(~late), "article", fields), "a")
    second = records(rows.where(late), "article", fields).union(records(rows.where(mid), "article", fields, -1))
    return kept.apply(second, "b").apply(second, "b").apply(records(rows.where(mid), "article", fields), "c").counts()


def p4_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, marginals, lift and log-likelihood ratio of every pair of drug and disease."""
    one = cooccurrence.pair_records(table(spark, sf_dir, TRANSLATION), "batch_id", "normalized_key", "merged_umls_label", "merged_mondo_label", "preclinical_count")
    found = cooccurrence.associations(one, "batch", "drug", "disease", "n")
    return found.select(F.col("item").alias("merged_umls_label"), F.col("other").alias("merged_mondo_label"), "n", "u", "d", "t", F.round("lift", 4).alias("lift"), F.round("llr", 3).alias("llr"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.strong(p4_associations(spark, sf_dir), 20, 4).select("merged_umls_label", "merged_mondo_label")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 512 tokens of every longer record, each sharing 128 with the next."""
    return split_oversized(table(spark, sf_dir, NER), "rec_id", "tokens", "ner_tags")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 2").select("rec_id")


def _overlap(spark: SparkSession, sf_dir: str) -> SplitOverlap:
    return SplitOverlap(table(spark, sf_dir, NER), "rec_id", "split_name", "tokens", "source")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one training and one dev or test record with the same or nearly the same words."""
    return _overlap(spark, sf_dir).pairs().select("rec_id_a", "rec_id_b")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records per split and source."""
    return _overlap(spark, sf_dir).report()


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its class and its number of links; copies are not expanded into pairs."""
    return _overlap(spark, sf_dir).membership()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by byte_bpe_50k; an empty list for null and empty texts."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of one longer than a container, in a container of 2,048 tokens."""
    sizes = encode(table(spark, sf_dir, "documents"), "doc_id", "text", counts=True)
    return pack(sizes, "row_id", "n_tokens").withColumnRenamed("row_id", "doc_id")


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are and how full."""
    return summary(p8_containers(spark, sf_dir))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "journal_name")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, or in several languages: one row for each language of the text."""
    return mislabelled(_languages(spark, sf_dir)).select(F.col("row_id").alias("doc_id"), "true_lang")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every text with its language and a confidence."""
    rows = _languages(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "declared", F.posexplode("segments").alias("pos", "s"))
    return rows.select("doc_id", "declared", "pos", "s.begin", "s.end", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.sentences")


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p1_incremental": p1_incremental,
    "p4_found": p4_found,
    "p4_associations": p4_associations,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_classes": p6_classes,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_summary": p8_summary,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}

_TERM = "trim(regexp_replace(lower({}), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_PAIRS = f"""
with named as (select batch_id, preclinical_count c,
    coalesce({_TERM.format('merged_umls_label')}, {_TERM.format("string_split(normalized_key, '<>')[2]")}) a,
    coalesce({_TERM.format('merged_mondo_label')}, {_TERM.format("string_split(normalized_key, '<>')[1]")}) b from {TRANSLATION}),
one as (select batch_id, a, b, max(c) c from named group by all),
pair as (select a, b, coalesce(sum(c), 0) n from one group by all),
full_pairs as (select a, b, n, sum(n) over (partition by a) u, sum(n) over (partition by b) d, sum(n) over () t from pair)
"""
_XLX = "case when {0} > 0 then {0} * ln({0}) else 0.0 end"
_X = lambda e: _XLX.format(f"(({e})::double)")
_LLR = f"greatest(0.0, 2 * (({_X('n')} + {_X('u-n')} + {_X('d-n')} + {_X('t-u-d+n')} - {_X('t')}) - ({_X('u')} + {_X('t-u')} - {_X('t')}) - ({_X('d')} + {_X('t-d')} - {_X('t')})))"
_BLANK = "'[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]*'"
ORACLES = {
    "p5_found": f"select rec_id from {NER} where len([x for x in tokens if x is not null and not regexp_full_match(x, {_BLANK})]) > 512",
    "p4_found": _PAIRS + "select a as merged_umls_label, b as merged_mondo_label from full_pairs where n >= 20 and n * t >= 4 * u * d",
    "p4_associations": _PAIRS + f"select a as merged_umls_label, b as merged_mondo_label, n::bigint as n, u::bigint as u, d::bigint as d, t::bigint as t, round(case when u > 0 and d > 0 then n::double * t / u / d end, 4) as lift, round({_LLR}, 3) as llr from full_pairs",
}

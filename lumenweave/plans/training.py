"""Queries p2 and p3, the general operators for training data, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.text import article
from lumenweave.operators import orphans as O
from lumenweave.operators.unpack import dictionary, unpack
from lumenweave.session import table

ENTITIES = "entities_drug_disease_preclin"
ANNOTATIONS = "full_text_combined_all_annotations_metadata"
METADATA = "full_pubmed_filtered_animal_6002827_metadata"


def disease_names(spark: SparkSession, sf_dir: str) -> list[str]:
    terms = table(spark, sf_dir, "ontology_terms")
    return dictionary(terms.select("name"), terms.select(F.explode("synonyms.text").alias("name")))


def disease_ids(spark: SparkSession, sf_dir: str) -> list[str]:
    return dictionary(table(spark, sf_dir, "ontology_terms").select("id"))


def drug_names(spark: SparkSession, sf_dir: str) -> list[str]:
    return dictionary(table(spark, sf_dir, "umls_concepts").select("str"))


def strain_names(spark: SparkSession, sf_dir: str) -> list[str]:
    t = table(spark, sf_dir, "strain_synonyms")
    return dictionary(t.select("synonym"), t.select("strainname"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed cell of the four fields, with its position."""
    entities, notes = table(spark, sf_dir, ENTITIES), table(spark, sf_dir, ANNOTATIONS)
    parts = [
        unpack(entities, "entity_row_id", "merged_mondo_label", disease_names(spark, sf_dir), 2, ENTITIES),
        unpack(entities, "entity_row_id", "merged_umls_label", drug_names(spark, sf_dir), 2, ENTITIES),
        unpack(entities, "entity_row_id", "merged_mondo_termid", disease_ids(spark, sf_dir), 2, ENTITIES),
        unpack(notes, "annotation_row_id", "animal_strain", strain_names(spark, sf_dir), 2, ANNOTATIONS),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, notes = table(spark, sf_dir, ENTITIES), table(spark, sf_dir, ANNOTATIONS)
    return entities.select(F.lit(ENTITIES).alias("ref_table"), F.col("entity_row_id").alias("row_id"), article(F.col("pmid")).alias("key"), F.col("loaded_at").alias("at")).union(
        notes.select(F.lit(ANNOTATIONS), "annotation_row_id", article(F.col("pmid")), "loaded_at")
    )


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, METADATA).select(article(F.col("pmid")).alias("key"), "loaded_at", "is_deleted", F.when(F.col("year").between(1800, F.year("loaded_at") + 1), F.col("year")).alias("year"))
    return O.orphans(references(spark, sf_dir), O.parents(meta, "key", "loaded_at", "is_deleted", "year"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both referring tables that refer to an article which is missing, deleted or arrives later."""
    return _orphans(spark, sf_dir).select("ref_table", "row_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, counted per referring table and year."""
    return O.report(_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found}

_NUMBER = "try_cast(regexp_extract(pmid, '(?i)^\\s*(?:pmid)?\\s*:?\\s*0*([0-9]+)(?:\\.0*)?\\s*$', 1) as bigint)"
_MISSES = f"""
with meta as (select {_NUMBER} k, loaded_at w, coalesce(is_deleted, false) d,
    case when year between 1800 and year(loaded_at) + 1 then year end y from {METADATA}),
article as (select k, min(w) earliest, max(struct_pack(w := w, d := d)).d gone, (max(struct_pack(w := w, y := y)) filter (where y is not null)).y y from meta where k is not null group by k),
refs as (select '{ENTITIES}' ref_table, entity_row_id row_id, {_NUMBER} k, loaded_at w from {ENTITIES}
    union all select '{ANNOTATIONS}', annotation_row_id, {_NUMBER}, loaded_at from {ANNOTATIONS}),
misses as (select refs.*, case when article.k is null then 'missing' when gone then 'deleted' else 'later' end reason, coalesce(y, year(refs.w)) as yr
    from refs left join article using (k) where refs.k is not null and (article.k is null or gone or earliest > refs.w))
"""
ORACLES = {
    "p2_found": _MISSES + "select ref_table, row_id from misses",
    "p2_report": _MISSES + "select ref_table, cast(yr as int) as year, count(*) as orphans, count(*) filter (where reason = 'missing') as missing, count(*) filter (where reason = 'deleted') as deleted, count(*) filter (where reason = 'later') as later from misses group by 1, 2",
}

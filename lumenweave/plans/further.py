"""Further queries over labels, nested records and running titles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.plans.registry import Registry
from lumenweave.plans.training import METADATA as META
from lumenweave.session import table

TR = "translation_table_drug_disease_full"
query = Registry()


@query("pr21_status_label", f"select pair_row_id, case when at_least_one_phase4 or fda_earliest_year is not null then 'approved' else 'failed' end as status from {TR}")
def _(s, d):
    up = F.coalesce("at_least_one_phase4", F.lit(False)) | F.col("fda_earliest_year").isNotNull()
    return table(s, d, TR).select("pair_row_id", F.when(up, "approved").otherwise("failed").alias("status"))


@query("f06_dash_unification", f"select meta_row_id, translate(title, '–—−‐‑‒―≈∼≅～', '-------') as title from {META}")
def _(s, d):
    """One dash for all, and no signs for "about"."""
    return table(s, d, META).select("meta_row_id", F.translate("title", "–—−‐‑‒―≈∼≅～", "-------").alias("title"))


@query("f65_records_by_part", f"select pair_row_id, t.doc, t.year, trim(p) as product from (select pair_row_id, unnest([{{'doc': clinical_doc_ids[i], 'status': upper(trim(overall_status[i])), 'year': final_trial_year[i]}} for i in range(1, len(clinical_doc_ids) + 1)]) t, string_split(merged_umls_label, ' ') ps from {TR} where merged_umls_label is not null), unnest(ps) u(p) where t.status = 'COMPLETED' and t.doc is not null")
def _(s, d):
    """Nested records flattened: each completed trial with each part of the product's name."""
    t = table(s, d, TR).where("merged_umls_label is not null").select("pair_row_id", F.arrays_zip("clinical_doc_ids", "overall_status", "final_trial_year").alias("z"), F.split("merged_umls_label", " ").alias("ps"))
    flat = t.select("pair_row_id", "ps", F.explode("z").alias("z")).where((F.upper(F.trim("z.overall_status")) == "COMPLETED") & F.col("z.clinical_doc_ids").isNotNull())
    return flat.select("pair_row_id", F.col("z.clinical_doc_ids").alias("doc"), F.col("z.final_trial_year").alias("year"), F.explode("ps").alias("p")).select("pair_row_id", "doc", "year", F.trim("p").alias("product"))


@query("f13_token_removal", f"select pair_row_id, array_to_string([p for p in phase if p <> 'NA'], ',') as phases from {TR} where phase is not null")
def _(s, d):
    return table(s, d, TR).where("phase is not null").select("pair_row_id", F.array_join(F.array_remove("phase", "NA"), ",").alias("phases"))


@query("f17_safe_name", "select id, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') as file_name from ontology_terms")
def _(s, d):
    return table(s, d, "ontology_terms").select("id", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_").alias("file_name"))


@query("f65_nested_flatten", "select id, x.text as synonym, x.scope as scope, p as parent from (select id, unnest(synonyms) x, parents from ontology_terms), unnest(parents) as t(p) where x.scope <> 'BROAD'")
def _(s, d):
    t = table(s, d, "ontology_terms").select("id", "parents", F.explode("synonyms").alias("x")).where("x.scope <> 'BROAD'")
    return t.select("id", F.col("x.text").alias("synonym"), F.col("x.scope").alias("scope"), F.explode("parents").alias("parent"))


@query("f66_running_title", "select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as since from events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return table(s, d, "events").select("event_id", F.last(mark, ignorenulls=True).over(w).alias("since"))


@query("f73_json_columns", "select event_id, event_type, try_cast(json_extract_string(props, '$.k') as int) as props_k from events")
def _(s, d):
    t = table(s, d, "events").select("event_id", "event_type", F.from_json("props", "struct<k:int>").alias("props"))
    return t.select("event_id", "event_type", F.col("props.k").alias("props_k"))

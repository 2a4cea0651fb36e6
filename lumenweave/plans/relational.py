"""Queries over filters, joins, sets, order and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions.text import article, term
from lumenweave.operators import relational as R
from lumenweave.plans.registry import Registry
from lumenweave.plans.training import ANNOTATIONS as ANN
from lumenweave.plans.training import ENTITIES as ENT
from lumenweave.plans.training import METADATA as META
from lumenweave.plans.training import _NUMBER as NUM
from lumenweave.session import table

TR, NER = "translation_table_drug_disease_full", "drug_disease_ner"
query = Registry()

ROUTES = ["protects", "model", "effects", "course"]
PATTERNS = {"type": r"type \d", "stage": r"late stage", "early": r"\bearly\b", "severe": r"severe form"}


@query("pr01_select_rename", f'select meta_row_id as row_id, pmid as "PMID", journal_name as journal from {META}')
def _(s, d):
    return table(s, d, META).select(F.col("meta_row_id").alias("row_id"), F.col("pmid").alias("PMID"), F.col("journal_name").alias("journal"))


@query("pr02_prefix_columns", "select cui as umls_cui, str as umls_str, ispref as umls_ispref, tty as umls_tty, sab as umls_sab, srl as umls_srl, sty as umls_sty, scui as umls_scui from umls_concepts")
def _(s, d):
    return R.prefixed(table(s, d, "umls_concepts"), "umls_")


@query("pr03_pair_key", f"select pair_row_id, merged_mondo_label || ' <> ' || merged_umls_label as pair from {TR}")
def _(s, d):
    return table(s, d, TR).select("pair_row_id", R.pair_key(F.col("merged_mondo_label"), F.col("merged_umls_label")).alias("pair"))


@query("pr04_key_inversion", f"select pair_row_id, trim(split_part(normalized_key, '<>', 2)) as drug from {TR} where normalized_key is not null")
def _(s, d):
    return table(s, d, TR).where("normalized_key is not null").select("pair_row_id", F.trim(F.split_part("normalized_key", F.lit("<>"), F.lit(2))).alias("drug"))


@query("pr05_text_concat", f"select meta_row_id, title || ' | ' || journal_name as text from {META}")
def _(s, d):
    return table(s, d, META).select("meta_row_id", F.concat("title", F.lit(" | "), "journal_name").alias("text"))


@query("pr06_missing_flag", f"select meta_row_id, coalesce(publication_type, '') in ('', 'N/A') as missing from {META}")
def _(s, d):
    return table(s, d, META).select("meta_row_id", F.coalesce("publication_type", F.lit("")).isin("", "N/A").alias("missing"))


@query("pr07_substring_filter", f"select meta_row_id, title from {META} where coalesce(contains(lower(title), 'model of'), false)")
def _(s, d):
    return table(s, d, META).where(R.contains(F.col("title"), "model of")).select("meta_row_id", "title")


@query("pr08_keyword_routing", f"with one as (select k, arg_min(title, meta_row_id) as title from (select {NUM} k, meta_row_id, title from {META}) where k is not null and title is not null group by 1) select k, case when contains(lower(title), 'protects') then 'protects' when contains(lower(title), 'model') then 'model' when contains(lower(title), 'effects') then 'effects' when contains(lower(title), 'course') then 'course' else 'rest' end as route from one")
def _(s, d):
    """Each article once, by its first row with a title, under the first keyword it has; the rest too."""
    rows = table(s, d, META).select(article(F.col("pmid")).alias("k"), "meta_row_id", "title").where("k is not null and title is not null")
    one = rows.groupBy("k").agg(F.min_by("title", "meta_row_id").alias("title"))
    return one.select("k", F.coalesce(R.route(F.col("title"), ROUTES), F.lit("rest")).alias("route"))


@query("pr09_multi_pattern", f"with m as (select {NUM} as k, lower(title) t from {META}) select distinct k, label from (select k, case when regexp_matches(t, 'type [0-9]') then 'type' end as label from m union all select k, case when contains(t, 'late stage') then 'stage' end from m union all select k, case when regexp_matches(t, '\\bearly\\b') then 'early' end from m union all select k, case when contains(t, 'severe form') then 'severe' end from m) where label is not null")
def _(s, d):
    hits = table(s, d, META).select(article(F.col("pmid")).alias("k"), R.labels_matching(F.col("title"), PATTERNS).alias("labels"))
    return hits.select("k", F.explode("labels").alias("label")).distinct()


@query("pr10_semi_filter", f"with a as (select {NUM} k from {ANN}), e as (select entity_row_id, {NUM} k from {ENT}) select entity_row_id from e where k in (select k from a where k is not null)")
def _(s, d):
    left = table(s, d, ENT).select("entity_row_id", article(F.col("pmid")).alias("k"))
    return left.join(table(s, d, ANN).select(article(F.col("pmid")).alias("k")), "k", "left_semi").select("entity_row_id")


@query("pr11_exclusion_list", f"with bad as (select {NUM} k from {META} where publication_type in ('Letter', 'Review') union select {NUM} from {META} where is_deleted), m as (select entity_row_id, {NUM} k from {ENT}) select entity_row_id from m where k is null or k not in (select k from bad where k is not null)")
def _(s, d):
    meta = table(s, d, META).select(article(F.col("pmid")).alias("k"), "publication_type", "is_deleted")
    rows = table(s, d, ENT).select("entity_row_id", article(F.col("pmid")).alias("k"))
    return R.without(rows, F.col("k"), meta.where(F.col("publication_type").isin("Letter", "Review")).select("k"), meta.where("is_deleted").select("k")).select("entity_row_id")


@query("pr12_any_element", f"select pair_row_id from {TR} where len([p for p in phase if contains(lower(p), 'phase3') or contains(lower(p), 'phase 3')]) > 0")
def _(s, d):
    return table(s, d, TR).where(F.exists("phase", lambda p: F.lower(p).contains("phase3") | F.lower(p).contains("phase 3"))).select("pair_row_id")


@query("pr13_flag_filters", f"select annotation_row_id, greatest(b, r, w) = 1 as any_flag, b = 1 and r + w = 0 as only_blinding from (select annotation_row_id, (coalesce(rigor_blinding, '') = 'reported')::int b, (coalesce(rigor_randomization, '') = 'reported')::int r, (coalesce(rigor_welfare, '') = 'reported')::int w from {ANN})")
def _(s, d):
    flag = lambda c: (F.coalesce(F.col(c), F.lit("")) == "reported").cast("int")
    t = table(s, d, ANN).select("annotation_row_id", flag("rigor_blinding").alias("b"), flag("rigor_randomization").alias("r"), flag("rigor_welfare").alias("w"))
    return t.select("annotation_row_id", (F.greatest("b", "r", "w") == 1).alias("any_flag"), ((F.col("b") == 1) & (F.col("r") + F.col("w") == 0)).alias("only_blinding"))


@query("pr14_length_filter", f"select kind, count(*) as n from (select unnest(string_split(publication_type, '+')) kind from {META}) where length(trim(kind)) > 3 group by 1")
def _(s, d):
    kinds = table(s, d, META).select(F.explode(F.split("publication_type", r"\+")).alias("kind"))
    return kinds.where(F.length(F.trim("kind")) > 3).groupBy("kind").agg(F.count("*").alias("n"))


@query("pr15_drop_nulls", f"select pair_row_id, preclinical_count from {TR} where merged_mondo_label is not null and preclinical_count is not null")
def _(s, d):
    return table(s, d, TR).na.drop(subset=["merged_mondo_label", "preclinical_count"]).select("pair_row_id", "preclinical_count")


@query("pr16_linked_predicate", f"select pair_row_id from {TR} where trim(merged_mondo_termid) <> '-1' and trim(merged_umls_termid) <> '-1'")
def _(s, d):
    return table(s, d, TR).where((F.trim("merged_mondo_termid") != "-1") & (F.trim("merged_umls_termid") != "-1")).select("pair_row_id")


@query("pr17_fallback_fill", f"select entity_row_id, coalesce(merged_mondo_label, nearest_dataset_parent_label, disease_mondo_term_norm) as label from {ENT}")
def _(s, d):
    return table(s, d, ENT).select("entity_row_id", F.coalesce("merged_mondo_label", "nearest_dataset_parent_label", "disease_mondo_term_norm").alias("label"))


_YEARS = "list_min(trial_start_year) a, list_min(final_trial_year) b, list_min(pub_year) c"


@query("pr18_fill_least", f"select pair_row_id, coalesce(a, least(b, c)) as start_year from (select pair_row_id, {_YEARS} from {TR})")
def _(s, d):
    a, b, c = (F.array_min(x) for x in ("trial_start_year", "final_trial_year", "pub_year"))
    return table(s, d, TR).select("pair_row_id", F.coalesce(a, F.least(b, c)).alias("start_year"))


@query("pr19_sentinel_fill", f"with a as (select {NUM} k, min(nullif(animal_sex, 'not reported')) sex from {ANN} group by 1), e as (select entity_row_id, {NUM} k from {ENT}) select entity_row_id, coalesce(sex, case when a.k is not null then 'unlabeled' else 'no full text' end) as sex from e left join a using (k)")
def _(s, d):
    a = table(s, d, ANN).select(article(F.col("pmid")).alias("k"), F.nullif("animal_sex", F.lit("not reported")).alias("x")).where("k is not null").groupBy("k").agg(F.min("x").alias("sex"), F.lit(True).alias("full"))
    e = table(s, d, ENT).select("entity_row_id", article(F.col("pmid")).alias("k"))
    return e.join(a, "k", "left").select("entity_row_id", F.coalesce("sex", F.when(F.col("full"), "unlabeled").otherwise("no full text")).alias("sex"))


@query("pr20_source_counters", f"select count(*) filter (where a is not null) as from_start, count(*) filter (where a is null and b is not null) as from_final, count(*) filter (where a is null and b is null and c is not null) as from_pub, count(*) filter (where a is null and b is null and c is null) as missing from (select {_YEARS} from {TR})")
def _(s, d):
    t = table(s, d, TR).select(F.array_min("trial_start_year").alias("a"), F.array_min("final_trial_year").alias("b"), F.array_min("pub_year").alias("c"))
    return t.agg(F.count_if(F.col("a").isNotNull()).alias("from_start"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("from_final"), F.count_if(F.col("a").isNull() & F.col("b").isNull() & F.col("c").isNotNull()).alias("from_pub"), F.count_if(F.coalesce("a", "b", "c").isNull()).alias("missing"))


@query("pr22_zscore_outliers", "with p as (select l_partkey, avg(l_quantity) q, avg(l_extendedprice) e from lineitem group by 1), st as (select avg(q) mq, stddev_samp(q) sq, avg(e) me, stddev_samp(e) se from p) select l_partkey, round(greatest(abs((q - mq) / sq), abs((e - me) / se)), 6) as max_z from p, st where greatest(abs((q - mq) / sq), abs((e - me) / se)) > 2.5")
def _(s, d):
    p = table(s, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"))
    return R.outliers(p, ["q", "e"], 2.5).select("l_partkey", F.round("max_z", 6).alias("max_z"))


@query("pr23_busy_years", f"select m.meta_row_id, m.year from {META} m where year between 1980 and 2024 and year in (select year from {META} group by 1 having count(*) >= 25)")
def _(s, d):
    m = table(s, d, META)
    busy = m.groupBy("year").agg(F.count("*").alias("n")).where("n >= 25").select("year")
    return m.where(F.col("year").between(1980, 2024)).join(busy, "year", "left_semi").select("meta_row_id", "year")


_REPORTED = "not coalesce(lower(trim({0})), '') in ('', 'not reported', 'unlabeled', 'nan')"


@query("pr24_reported_percent", " union all ".join(f"select '{c}' as field, count(*) as n, count(*) filter (where {_REPORTED.format(c)}) as reported, round(100.0 * count(*) filter (where {_REPORTED.format(c)}) / count(*), 4) as percent from {ANN}" for c in ("animal_sex", "animal_species", "assay_type", "animal_strain")))
def _(s, d):
    cols = ["animal_sex", "animal_species", "assay_type", "animal_strain"]
    long = table(s, d, ANN).select(*cols).unpivot([], cols, "field", "cell")
    said = ~F.coalesce(F.lower(F.trim("cell")), F.lit("")).isin("", "not reported", "unlabeled", "nan")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(said).alias("reported")).withColumn("percent", F.round(100.0 * F.col("reported") / F.col("n"), 4))


@query("j01_left_enrich", f"with m as (select k, (max(struct_pack(w := loaded_at, i := meta_row_id, y := year, j := journal_name))) r from (select *, {NUM} k from {META}) group by k), e as (select entity_row_id, {NUM} k from {ENT}) select entity_row_id, r.y as year, r.j as journal_name from e left join m using (k)")
def _(s, d):
    m = table(s, d, META).select(article(F.col("pmid")).alias("k"), F.struct("loaded_at", "meta_row_id", "year", "journal_name").alias("r")).where("k is not null").groupBy("k").agg(F.max("r").alias("r"))
    e = table(s, d, ENT).select("entity_row_id", article(F.col("pmid")).alias("k"))
    return e.join(m, "k", "left").select("entity_row_id", "r.year", "r.journal_name")


@query("j02_composite_key", "select l_orderkey, l_linenumber, o_orderdate from lineitem join orders on l_orderkey = o_orderkey and year(l_shipdate) = year(o_orderdate)")
def _(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    return li.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.year("l_shipdate") == F.year("o_orderdate"))).select("l_orderkey", "l_linenumber", "o_orderdate")


_A = f"(select distinct {NUM} k, drug_umls_termid u from {ENT})"
_B = f"(select distinct {NUM} k, disease_mondo_termid v from {ENT})"


@query("j03_inner_sides", f"select k, u, v from {_A} join {_B} using (k)")
def _(s, d):
    e = table(s, d, ENT).withColumn("k", article(F.col("pmid")))
    return e.select("k", F.col("drug_umls_termid").alias("u")).distinct().join(e.select("k", F.col("disease_mondo_termid").alias("v")).distinct(), "k")


@query("j04_outer_overlap", f"with a as (select {NUM} k, count(*) n from {ENT} group by 1), b as (select {NUM} k, count(*) m from {ANN} group by 1) select k, n, m from a full join b using (k) where n is not null and m is not null")
def _(s, d):
    a = table(s, d, ENT).groupBy(article(F.col("pmid")).alias("k")).agg(F.count("*").alias("n"))
    b = table(s, d, ANN).groupBy(article(F.col("pmid")).alias("k")).agg(F.count("*").alias("m"))
    return a.join(b, "k", "full_outer").where("n is not null and m is not null").select("k", "n", "m")


@query("j05_flag_join", f"with b as (select distinct {NUM} k, true f from {ANN} where animal_sex = 'both') select entity_row_id, coalesce(f, false) as both_sexes from (select entity_row_id, {NUM} ek from {ENT}) left join b on ek = k")
def _(s, d):
    b = table(s, d, ANN).where("animal_sex = 'both'").select(article(F.col("pmid")).alias("k"), F.lit(True).alias("f")).distinct()
    e = table(s, d, ENT).select("entity_row_id", article(F.col("pmid")).alias("ek"))
    return e.join(b, F.col("ek") == F.col("k"), "left").select("entity_row_id", F.coalesce("f", F.lit(False)).alias("both_sexes"))


@query("j06_explode_join", f"with t as (select pair_row_id, unnest(preclinical_doc_ids) p from {TR}), a as (select distinct {NUM} k, animal_species from {ANN}) select pair_row_id, animal_species, count(*) as n from t join a on try_cast(trim(p) as bigint) = k group by 1, 2")
def _(s, d):
    t = table(s, d, TR).select("pair_row_id", F.explode("preclinical_doc_ids").alias("p")).withColumn("k", F.trim("p").try_cast("bigint"))
    a = table(s, d, ANN).select(article(F.col("pmid")).alias("k"), "animal_species").distinct()
    return t.join(a, "k").groupBy("pair_row_id", "animal_species").agg(F.count("*").alias("n"))


_ONE = "(select {0} k, min({1}) {1} from " + ANN + " group by 1)"


@query("j07_chained_merge", f"select k, coalesce(animal_sex, 'not reported') as animal_sex, coalesce(animal_species, 'not reported') as animal_species, coalesce(assay_type, 'not reported') as assay_type from {_ONE.format(NUM, 'animal_sex')} left join {_ONE.format(NUM, 'animal_species')} using (k) left join {_ONE.format(NUM, 'assay_type')} using (k) where k is not null")
def _(s, d):
    a = table(s, d, ANN).withColumn("k", article(F.col("pmid"))).where("k is not null")
    one = [a.groupBy("k").agg(F.min(c).alias(c)) for c in ("animal_sex", "animal_species", "assay_type")]
    return R.chained(one[0], "k", one[1:], "not reported")


@query("j08_unmatched", f"with a as (select distinct {NUM} k from {ANN}), b as (select distinct {NUM} k from {ENT}) select 'annotation' as side, k from a where k is not null and k not in (select k from b where k is not null) union all select 'entity', k from b where k is not null and k not in (select k from a where k is not null)")
def _(s, d):
    a, b = (table(s, d, t).select(article(F.col("pmid")).alias("k")).where("k is not null").distinct() for t in (ANN, ENT))
    return a.join(b, "k", "left_anti").select(F.lit("annotation").alias("side"), "k").union(b.join(a, "k", "left_anti").select(F.lit("entity"), "k"))


@query("j18_positional_zip", f"select entity_row_id, i, trim(a[i]) as label, trim(b[i]) as id from (select entity_row_id, string_split(disease_mondo_term_norm, '|') a, string_split(disease_mondo_termid, '|') b from {ENT}), unnest(range(1, least(len(a), len(b)) + 1)) as r(i)")
def _(s, d):
    t = table(s, d, ENT).select("entity_row_id", F.split("disease_mondo_term_norm", r"\|").alias("a"), F.split("disease_mondo_termid", r"\|").alias("b"))
    z = t.select("entity_row_id", F.slice(F.arrays_zip("a", "b"), F.lit(1), F.least(F.size("a"), F.size("b"))).alias("z"))
    return z.select("entity_row_id", F.posexplode("z").alias("p", "x")).select("entity_row_id", (F.col("p") + 1).cast("bigint").alias("i"), F.trim("x.a").alias("label"), F.trim("x.b").alias("id"))


@query("j19_right_join", "select r_name, n_name from nation right join region on n_regionkey = r_regionkey and n_name like 'A%'")
def _(s, d):
    return table(s, d, "nation").where("n_name like 'A%'").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").select("r_name", "n_name")


_SETS = f"with a as (select distinct {NUM} k from {ENT}), b as (select distinct {NUM} k from {ANN}), c as (select distinct {NUM} k from documents), u as (select k, k in (select k from a where k is not null) x, k in (select k from b where k is not null) y, k in (select k from c where k is not null) z from (select k from a union select k from b union select k from c) where k is not null)"


@query("j20_three_way_overlap", _SETS + " select x as in_entities, y as in_annotations, z as in_documents, count(*) as n from u group by all")
def _(s, d):
    sets = {"entities": ENT, "annotations": ANN, "documents": "documents"}
    flags = R.overlap({n: table(s, d, t).select(article(F.col("pmid"))) for n, t in sets.items()}, "k")
    return flags.groupBy("in_entities", "in_annotations", "in_documents").agg(F.count("*").alias("n"))


@query("u01_union_by_name", f"select pmid, year, journal_name, null::varchar as lang from {META} union all by name select pmid, journal_name, lang from documents")
def _(s, d):
    return table(s, d, META).select("pmid", "year", "journal_name").unionByName(table(s, d, "documents").select("pmid", "journal_name", "lang"), allowMissingColumns=True)


@query("u02_columns_by_id", f"select a.meta_row_id, a.year, b.journal_name from {META} a join {META} b using (meta_row_id)")
def _(s, d):
    m = table(s, d, META)
    return m.select("meta_row_id", "year").join(m.select("meta_row_id", "journal_name"), "meta_row_id")


@query("u03_set_difference", f"(select {NUM} as k from {ENT} intersect select {NUM} from {META}) except select {NUM} from {ANN}")
def _(s, d):
    k = lambda t: table(s, d, t).select(article(F.col("pmid")).alias("k"))
    return k(ENT).intersect(k(META)).subtract(k(ANN))


@query("u04_overlap_counts", _SETS + " select count(*) filter (where x and y and z) as all_three, count(*) filter (where x and not y and not z) as entities_only, count(*) filter (where x and y) as both_first from u")
def _(s, d):
    sets = {"x": ENT, "y": ANN, "z": "documents"}
    f = R.overlap({n: table(s, d, t).select(article(F.col("pmid"))) for n, t in sets.items()}, "k")
    return f.agg(F.count_if(F.col("in_x") & F.col("in_y") & F.col("in_z")).alias("all_three"), F.count_if(F.col("in_x") & ~F.col("in_y") & ~F.col("in_z")).alias("entities_only"), F.count_if(F.col("in_x") & F.col("in_y")).alias("both_first"))


_RANKS = " ".join(f"when '{x}' then {i}" for i, x in enumerate(["fulltext_xml", "fulltext_html", "fulltext_pdf", "plain"]))


@query("u05_priority_union", f"select k, source, doc_id from (select *, row_number() over (partition by k order by r, doc_id) n from (select {NUM} k, source, doc_id, case source {_RANKS} end r from documents where source <> 'pubmed_abstract' and text is not null) where k is not null) where n = 1")
def _(s, d):
    docs = table(s, d, "documents").where("text is not null").select(article(F.col("pmid")).alias("k"), "source", "doc_id").where("k is not null")
    parts = [docs.where(F.col("source") == x) for x in ("fulltext_xml", "fulltext_html", "fulltext_pdf", "plain")]
    return R.first_source_wins(parts, "k", [F.col("doc_id")])


@query("k01_multi_key_sort", f"select pair_row_id, preclinical_count, clinical_count, row_number() over (order by preclinical_count desc nulls last, clinical_count desc nulls last, pair_row_id) as place from {TR}")
def _(s, d):
    """Every row with its place."""
    order = [F.desc_nulls_last("preclinical_count"), F.desc_nulls_last("clinical_count"), F.asc("pair_row_id")]
    return R.numbered(table(s, d, TR).select("pair_row_id", "preclinical_count", "clinical_count"), order, "place")


@query("k02_top_n", f"select journal_name, count(*) as n from {META} where journal_name is not null group by 1 order by n desc, journal_name limit 20")
def _(s, d):
    return table(s, d, META).where("journal_name is not null").groupBy("journal_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "journal_name").limit(20)


@query("k03_top_k_per_class", f"select animal_species, journal_name, n, rank from (select *, row_number() over (partition by animal_species order by n desc, journal_name) as rank from (select animal_species, journal_name, count(*) n from {ANN} where journal_name is not null group by 1, 2)) where rank <= 5")
def _(s, d):
    n = table(s, d, ANN).where("journal_name is not null").groupBy("animal_species", "journal_name").agg(F.count("*").alias("n"))
    return R.top_per_class(n, "animal_species", [F.desc("n"), F.asc("journal_name")], 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("k04_tail", f"select meta_row_id, loaded_at from {META} order by loaded_at desc, meta_row_id desc limit 10")
def _(s, d):
    return table(s, d, META).select("meta_row_id", "loaded_at").orderBy(F.desc("loaded_at"), F.desc("meta_row_id")).limit(10)


@query("k05_drop_duplicates", f"select k, min(meta_row_id) as first_row from (select {NUM} k, meta_row_id from {META}) where k is not null group by 1")
def _(s, d):
    rows = table(s, d, META).select(article(F.col("pmid")).alias("k"), F.col("meta_row_id").alias("first_row")).where("k is not null")
    return R.keep_first(rows, ["k"], [F.col("first_row")])


@query("k06_ordered_distinct", f"select entity_row_id, list_aggregate(list_transform(list_sort(list_transform(list_distinct(a), lambda x: {{'p': list_position(a, x), 'x': x}})), lambda s: s.x), 'string_agg', '|') as cell from (select entity_row_id, string_split(unique_interventions_linkbert_predictions, '|') a from {ENT} where unique_interventions_linkbert_predictions is not null)")
def _(s, d):
    return table(s, d, ENT).where("unique_interventions_linkbert_predictions is not null").select("entity_row_id", F.array_join(F.array_distinct(F.split("unique_interventions_linkbert_predictions", r"\|")), "|").alias("cell"))


@query("k07_seeded_sample", f"select entity_row_id from {ENT} order by md5(entity_row_id::varchar), entity_row_id limit 100")
def _(s, d):
    return R.sample(table(s, d, ENT).select("entity_row_id"), "entity_row_id", 100)


@query("k08_second_sample", f"with a as (select entity_row_id from {ENT} order by md5(entity_row_id::varchar), entity_row_id limit 100) select entity_row_id from {ENT} where entity_row_id not in (select * from a) and not coalesce(contains(lower(merged_umls_label), 'sodium'), false) order by md5(entity_row_id::varchar), entity_row_id limit 100")
def _(s, d):
    e = table(s, d, ENT).select("entity_row_id", "merged_umls_label")
    rest = e.join(R.sample(e.select("entity_row_id"), "entity_row_id", 100), "entity_row_id", "left_anti").where(~R.contains(F.col("merged_umls_label"), "sodium"))
    return R.sample(rest.select("entity_row_id"), "entity_row_id", 100)


@query("k09_stratified_split", "select doc_id, source, case when p < 0.8 then 'train' when p < 0.8 + 0.1 then 'dev' else 'test' end as split from (select doc_id, source, (row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1)::double / count(*) over (partition by source) p from documents)")
def _(s, d):
    return R.stratified(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 0.8, 0.1)


@query("k10_group_kfold", f"select rec_id, (('0x' || substr(md5(string_split(doc_id, '_')[2]), 1, 7))::bigint % 10)::int as fold from {NER} where doc_id is not null")
def _(s, d):
    group = F.split("doc_id", "_")[1]
    return table(s, d, NER).where("doc_id is not null").select("rec_id", F.pmod(F.conv(F.substring(F.md5(group), 1, 7), 16, 10).cast("bigint"), F.lit(10)).cast("int").alias("fold"))


@query("s21_strided_split", "select o_orderkey, (o_orderkey % 7)::int as part from orders")
def _(s, d):
    return R.split_ways(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("s21_contiguous_split", "select o_orderkey, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end::int as part from (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () // 7 q, count(*) over () % 7 r from orders)")
def _(s, d):
    return R.split_runs(table(s, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], parts=7)


@query("s21_fixed_size_split", "select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // 1000)::int as part from orders")
def _(s, d):
    return R.split_runs(table(s, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], size=1000)


@query("s23_checkpoint_resume", "select doc_id, coalesce(lang, source) as lang, false as pending from documents where lang is not null or doc_id % 3 <> 0 union all select doc_id, null, true from documents where lang is null and doc_id % 3 = 0")
def _(s, d):
    docs = table(s, d, "documents")
    done = docs.where("lang is null and doc_id % 3 <> 0").select("doc_id", F.col("source").alias("lang"))
    return R.resume(docs.select("doc_id", "lang"), done, "doc_id", "lang")

"""Queries over aggregates, cells and the translation table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave.functions import cells as C
from lumenweave.functions.text import article, term
from lumenweave.operators import relational as R
from lumenweave.operators import translation as T
from lumenweave.plans.registry import Registry
from lumenweave.plans.training import ANNOTATIONS as ANN
from lumenweave.plans.training import ENTITIES as ENT
from lumenweave.plans.training import METADATA as META
from lumenweave.plans.training import _NUMBER as NUM
from lumenweave.session import table, width

TR = "translation_table_drug_disease_full"
query = Registry()

_SIDES = """
with base as (select p_type || ' ' || p_size || ' <> ' || p_brand || ' ' || p_name as pair, l_orderkey as doc, l_linestatus st, l_returnflag fl, year(l_shipdate) y, year(o_orderdate) oy
    from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
c as (select pair, doc, min({'phase': case fl when 'A' then 'PHASE2' when 'N' then 'PHASE3' else 'PHASE4' end, 'status': case st when 'F' then 'COMPLETED' else 'ACTIVE' end, 'start': oy, 'final': y}) t from base where fl <> 'A' or st = 'F' group by 1, 2),
cl as (select pair, count(*) clinical_count, max(case t.phase when 'PHASE2' then 2.0 when 'PHASE3' then 3.0 else 4.0 end)::double max_phase, bool_or(t.phase = 'PHASE4') any4, bool_or(t.phase = 'PHASE3' and t.status = 'COMPLETED') done3, min(t.start) first_start, min(t.final) filter (where t.phase = 'PHASE3' and t.status = 'COMPLETED') first3 from c group by 1),
pr as (select pair, count(*) preclinical_count, min(y) first_paper, max(y) last_paper from (select pair, doc, min(oy) y from base group by 1, 2) group by 1)
"""


@query("translation_table", _SIDES + "select pair, clinical_count, preclinical_count, max_phase, any4 as any_phase4, done3 as completed_phase3, first_start, first3 as first_completed_phase3, first_paper, last_paper, case when any4 or done3 then 'approved' else 'failed' end as status from cl join pr using (pair)")
def translation_table(s, d):
    """The flagship: both sides of each pair aggregated, merged, and their features derived."""
    li, p, o = table(s, d, "lineitem"), table(s, d, "part"), table(s, d, "orders")
    pair = R.pair_key(F.concat_ws(" ", "p_type", "p_size"), F.concat_ws(" ", "p_brand", "p_name"))
    base = (
        li.select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", "l_shipdate")
        .join(p.select("p_partkey", pair.alias("pair")), F.col("l_partkey") == F.col("p_partkey"))
        .join(o.select("o_orderkey", F.year("o_orderdate").alias("oy")), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    phase = F.when(F.col("l_returnflag") == "A", "PHASE2").when(F.col("l_returnflag") == "N", "PHASE3").otherwise("PHASE4")
    clinical = (F.col("l_returnflag") != "A") | (F.col("l_linestatus") == "F")
    status = F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("ACTIVE")
    return T.pair_features(base.select("pair", F.col("l_orderkey").alias("doc"), clinical.alias("clinical"), phase.alias("phase"), status.alias("status"), F.col("oy").alias("start"), F.year("l_shipdate").alias("final"), F.col("oy").alias("year")))


@query("a01_collect_all_lists", f"select normalized_key, string_agg(pair_row_id || ':' || coalesce(preclinical_count::varchar, 'null'), ',' order by pair_row_id) as items, count(*) as n from {TR} group by 1")
def _(s, d):
    """Every row of each pair; rows without a key are a group of their own."""
    items = F.sort_array(F.collect_list(F.struct("pair_row_id", "preclinical_count")))
    text = F.array_join(F.transform(items, lambda x: F.concat(x["pair_row_id"].cast("string"), F.lit(":"), F.coalesce(x["preclinical_count"].cast("string"), F.lit("null")))), ",")
    return table(s, d, TR).groupBy("normalized_key").agg(text.alias("items"), F.count("*").alias("n"))


@query("a02_group_first", f"select {NUM} as k, arg_min(journal_name, meta_row_id) filter (where journal_name is not null) as journal from {META} where {NUM} is not null group by 1")
def _(s, d):
    m = table(s, d, META).select(article(F.col("pmid")).alias("k"), "journal_name", "meta_row_id").where("k is not null")
    return m.groupBy("k").agg(F.min_by("journal_name", F.when(F.col("journal_name").isNotNull(), F.col("meta_row_id"))).alias("journal"))


@query("a03_dedupe_then_count", f"select batch_id, count(*) as n, sum(c)::bigint as total from (select batch_id, normalized_key, arg_min(preclinical_count, pair_row_id) c from {TR} group by 1, 2) group by 1")
def _(s, d):
    one = R.keep_first(table(s, d, TR).select("batch_id", "normalized_key", "pair_row_id", "preclinical_count"), ["batch_id", "normalized_key"], [F.col("pair_row_id")])
    return one.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("preclinical_count").alias("total"))


@query("a04_distinct_per_group", f"select journal_name, count(distinct {NUM}) as articles, count(distinct year) as years from {META} group by 1")
def _(s, d):
    return table(s, d, META).groupBy("journal_name").agg(F.countDistinct(article(F.col("pmid"))).alias("articles"), F.countDistinct("year").alias("years"))


_TERMS = f"(select {NUM} k, trim(unnest(string_split(disease_mondo_term_norm, '|'))) term from {ENT})"


@query("a05_term_documents", f"select term, count(distinct k) as docs from {_TERMS} where term <> '' group by 1")
def _(s, d):
    e = table(s, d, ENT).select(article(F.col("pmid")).alias("k"), F.explode(C.tokens(F.col("disease_mondo_term_norm"))).alias("term"))
    return e.groupBy("term").agg(F.countDistinct("k").alias("docs"))


@query("a06_value_counts", f"select animal_species, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from {ANN} group by 1")
def _(s, d):
    return R.share(table(s, d, ANN).groupBy("animal_species").agg(F.count("*").alias("n")), "n")


@query("a07_pivot_total", "select coalesce(event_type, 'total') as event_type, count(*) filter (where h < 8) as night, count(*) filter (where h between 8 and 15) as day, count(*) filter (where h > 15) as evening from (select event_type, hour(ts) h from events) group by rollup (event_type)")
def _(s, d):
    part = F.when(F.hour("ts") < 8, "night").when(F.hour("ts") <= 15, "day").otherwise("evening")
    p = table(s, d, "events").select("event_type", part.alias("part")).groupBy("event_type").pivot("part", ["night", "day", "evening"]).count().na.fill(0)
    return p.rollup("event_type").agg(*[F.sum(c).alias(c) for c in ("night", "day", "evening")]).withColumn("event_type", F.coalesce("event_type", F.lit("total")))


@query("a08_yearly_shares", f"with f as (select k, min(year) y from (select {NUM} k, year from {META}) where year between 1900 and 2030 and k is not null group by 1), n as (select y, count(*) n from f group by 1) select y as year, n, round(avg(n) over (order by y rows between 4 preceding and current row), 4) as mean5, round(100.0 * n / sum(n) over (), 4) as percent from n")
def _(s, d):
    m = table(s, d, META).select(article(F.col("pmid")).alias("k"), "year").where("year between 1900 and 2030 and k is not null")
    n = m.groupBy("k").agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    w = Window.orderBy("year").rowsBetween(-4, 0)  # at most 131 rows
    return R.share(n.withColumn("mean5", F.round(F.avg("n").over(w), 4)), "n")


@query("a12_unique_concat", f"select normalized_key, string_agg(distinct p, ', ' order by p) as phases from (select normalized_key, trim(unnest(phase)) p from {TR}) where p <> '' group by 1")
def _(s, d):
    return table(s, d, TR).select("normalized_key", F.explode("phase").alias("p")).where("trim(p) <> ''").groupBy("normalized_key").agg(C.unique_join(F.col("p")).alias("phases"))


@query("a13_grouped_union", f"select merged_umls_label, string_agg(distinct fda_earliest_year::varchar, ', ' order by fda_earliest_year::varchar) as years, count(distinct batch_id) as batches from {TR} where fda_earliest_year is not null group by 1")
def _(s, d):
    t = table(s, d, TR).where("fda_earliest_year is not null")
    return t.groupBy("merged_umls_label").agg(C.unique_join(F.col("fda_earliest_year").cast("string")).alias("years"), F.countDistinct("batch_id").alias("batches"))


@query("a14_earliest_per_key", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) n from orders) where n = 1")
def _(s, d):
    return R.keep_first(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("a15_any_flag", f"select {NUM} as k, bool_or(coalesce(rigor_blinding, '') = 'reported') as blinding, bool_or(coalesce(rigor_welfare, '') = 'reported') as welfare from {ANN} group by 1")
def _(s, d):
    f = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit("")) == "reported")
    return table(s, d, ANN).groupBy(article(F.col("pmid")).alias("k")).agg(f("rigor_blinding").alias("blinding"), f("rigor_welfare").alias("welfare"))


_RIGOR = f"""
with a as (select {NUM} k, max((rigor_blinding = 'reported')::int) b, max((rigor_randomization = 'reported')::int) r, max((rigor_welfare = 'reported')::int) w from {ANN} group by 1),
t as (select distinct merged_umls_label drug, try_cast(trim(doc) as bigint) k from (select merged_umls_label, unnest(preclinical_doc_ids) doc from {TR}))
"""


def _rigor(s, d):
    f = lambda c: F.max((F.col(c) == "reported").cast("int"))
    a = table(s, d, ANN).groupBy(article(F.col("pmid")).alias("k")).agg(f("rigor_blinding").alias("b"), f("rigor_randomization").alias("r"), f("rigor_welfare").alias("w"))
    t = table(s, d, TR).select(F.col("merged_umls_label").alias("drug"), F.explode("preclinical_doc_ids").alias("x")).select("drug", F.trim("x").try_cast("bigint").alias("k")).distinct()
    return t.join(a, "k")


@query("a16_rigor_counts", _RIGOR + "select drug, count(*) as articles, coalesce(sum(b), 0)::bigint as blinded, coalesce(sum(r), 0)::bigint as randomized, coalesce(sum(w), 0)::bigint as welfare from t join a using (k) group by 1")
def _(s, d):
    return _rigor(s, d).groupBy("drug").agg(F.count("*").alias("articles"), F.coalesce(F.sum("b"), F.lit(0)).alias("blinded"), F.coalesce(F.sum("r"), F.lit(0)).alias("randomized"), F.coalesce(F.sum("w"), F.lit(0)).alias("welfare"))


@query("a17_any_percent", _RIGOR + "select count(*) as drugs, round(100.0 * count(*) filter (where m > 0) / count(*), 4) as percent_any from (select drug, greatest(coalesce(max(b), 0), coalesce(max(r), 0)) m from t join a using (k) group by 1)")
def _(s, d):
    g = _rigor(s, d).groupBy("drug").agg(F.greatest(F.coalesce(F.max("b"), F.lit(0)), F.coalesce(F.max("r"), F.lit(0))).alias("m"))
    return g.agg(F.count("*").alias("drugs"), F.round(100.0 * F.count_if(F.col("m") > 0) / F.count("*"), 4).alias("percent_any"))


_HET = f"""
with a as (select {NUM} k, nullif(nullif(lower(trim(animal_sex)), 'not reported'), '') sex, nullif(nullif(nullif(lower(trim(animal_species)), 'not reported'), ''), 'unlabeled') species, nullif(nullif(lower(trim(first_author_country)), 'not reported'), '') country,
    nullif(nullif(nullif(lower(trim(animal_strain)), 'not reported'), ''), 'unlabeled') strain, [trim(x) for x in string_split(lower(assay_type), ',') if trim(x) not in ('', 'not reported', 'unlabeled')] assay,
    coalesce((rigor_blinding = 'reported')::int, 0) + coalesce((rigor_randomization = 'reported')::int, 0) + coalesce((rigor_welfare = 'reported')::int, 0) flags from {ANN}),
t as (select distinct normalized_key pair, try_cast(trim(doc) as bigint) k from (select normalized_key, unnest(preclinical_doc_ids) doc from {TR})),
f as (select pair, count(distinct k) articles, bool_or(sex = 'both') or (bool_or(sex = 'male') and bool_or(sex = 'female')) both_sexes, count(distinct species) species, count(distinct country) countries, count(distinct strain) strains, coalesce(len(list_distinct(flatten(list(assay) filter (where assay is not null)))), 0) assays, count(distinct k) filter (where flags >= 2) rigorous from t join a using (k) group by 1)
"""


def heterogeneity(s, d):
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("not reported", "", "unlabeled"), F.lower(F.trim(c)))
    assay = F.filter(F.transform(F.split(F.lower("assay_type"), ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "not reported", "unlabeled"))
    flags = sum((F.coalesce((F.col(f"rigor_{c}") == "reported").cast("int"), F.lit(0)) for c in ("blinding", "randomization", "welfare")), F.lit(0))
    a = table(s, d, ANN).select(article(F.col("pmid")).alias("k"), clean("animal_sex").alias("sex"), clean("animal_species").alias("species"), clean("first_author_country").alias("country"), clean("animal_strain").alias("strain"), assay.alias("assay"), flags.alias("flags"))
    t = table(s, d, TR).select(F.col("normalized_key").alias("pair"), F.explode("preclinical_doc_ids").alias("x")).select("pair", F.trim("x").try_cast("bigint").alias("k")).distinct()
    has = lambda v: F.coalesce(F.bool_or(F.col("sex") == v), F.lit(False))
    return t.join(a, "k").groupBy("pair").agg(
        F.countDistinct("k").alias("articles"), (has("both") | (has("male") & has("female"))).alias("both_sexes"), F.countDistinct("species").alias("species"), F.countDistinct("country").alias("countries"),
        F.countDistinct("strain").alias("strains"), F.size(F.array_distinct(F.flatten(F.collect_set("assay")))).cast("bigint").alias("assays"), F.countDistinct(F.when(F.col("flags") >= 2, F.col("k"))).alias("rigorous"),
    )


@query("a18_heterogeneity", _HET + "select pair, articles, coalesce(both_sexes, false) as both_sexes, species, countries, strains, assays, rigorous from f")
def _(s, d):
    return heterogeneity(s, d)


_UP = f", s as (select normalized_key pair, bool_or(coalesce(at_least_one_phase4, false)) up from {TR} group by 1), v as (select up, unnest(['articles', 'species', 'countries', 'strains', 'assays', 'rigorous']) feature, unnest([articles, species, countries, strains, assays, rigorous])::double x from f join s using (pair))"


@query("a19_contrast", _HET + _UP + ", m as (select feature, avg(x) filter (where up) a, avg(x) filter (where not up) b, stddev_samp(x) filter (where up) sa, stddev_samp(x) filter (where not up) sb from v group by 1) select feature, round(a, 4) as reached, round(b, 4) as failed, round(100.0 * (a - b) / b, 4) as percent_more, printf('%.2f (%.2f)', round(a, 2), round(sa, 2)) as reached_cell, printf('%.2f (%.2f)', round(b, 2), round(sb, 2)) as failed_cell from m")
def _(s, d):
    """Mean of each feature of pairs that reached a phase 4 and of the others, the difference in percent, and cells for a table."""
    names = ["articles", "species", "countries", "strains", "assays", "rigorous"]
    up = table(s, d, TR).groupBy(F.col("normalized_key").alias("pair")).agg(F.bool_or(F.coalesce("at_least_one_phase4", F.lit(False))).alias("up"))
    long = heterogeneity(s, d).join(up, "pair").select("up", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["up"], names, "feature", "v")
    side = lambda f, yes: f(F.when(F.col("up") if yes else ~F.col("up"), F.col("v")))
    m = long.groupBy("feature").agg(side(F.avg, True).alias("a"), side(F.avg, False).alias("b"), side(F.stddev_samp, True).alias("sa"), side(F.stddev_samp, False).alias("sb"))
    cell = lambda x, y: F.format_string("%.2f (%.2f)", F.round(x, 2), F.round(y, 2))
    return m.select("feature", F.round("a", 4).alias("reached"), F.round("b", 4).alias("failed"), F.round(100.0 * F.try_divide(F.col("a") - F.col("b"), F.col("b")), 4).alias("percent_more"), cell("a", "sa").alias("reached_cell"), cell("b", "sb").alias("failed_cell"))


_T = "trim(regexp_replace(lower({0}), '[\\s\\x{{a0}}]+', ' ', 'g'))"
_REACH = f"with f as (select {_T.format('merged_umls_label')} drug, {_T.format('merged_mondo_label')} dis, sum(coalesce(clinical_count, 0)) c, sum(coalesce(preclinical_count, 0)) n, bool_or(fda_earliest_year is not null) fda, bool_or(coalesce(at_least_one_phase4, false)) p4 from {TR} where merged_umls_label is not null and merged_mondo_label is not null group by 1, 2)"


def _reach(s, d):
    t = table(s, d, TR).where("merged_umls_label is not null and merged_mondo_label is not null")
    return t.groupBy(term(F.col("merged_umls_label")).alias("drug"), term(F.col("merged_mondo_label")).alias("dis")).agg(
        F.sum(F.coalesce("clinical_count", F.lit(0))).alias("c"), F.sum(F.coalesce("preclinical_count", F.lit(0))).alias("n"), F.bool_or(F.col("fda_earliest_year").isNotNull()).alias("fda"), F.bool_or(F.coalesce("at_least_one_phase4", F.lit(False))).alias("p4")
    )


_ENDS = f"""with f as (select {_T.format('merged_umls_label')} drug, {_T.format('merged_mondo_label')} dis, sum(coalesce(preclinical_count, 0)) n, bool_or(coalesce(clinical_count, 0) > 0) c,
    bool_or(coalesce(at_least_one_phase4, false) or coalesce(at_least_one_phase3, false)) late, bool_or(fda_earliest_year is not null) ap, bool_or(coalesce(merged_umls_termid, '-1') <> '-1') ld, bool_or(coalesce(merged_mondo_termid, '-1') <> '-1') ls
    from {TR} where merged_umls_label is not null and merged_mondo_label is not null group by 1, 2 having sum(coalesce(preclinical_count, 0)) > 0)"""


def _reach_sql(rows: str, often: str) -> str:
    n = {
        "total": "count(*)", "frequent": f"count(*) filter (where {often})", "linked": "count(*) filter (where l)", "frequent_linked": f"count(*) filter (where l and ({often}))", "approved_only": "count(*) filter (where ap and not c)",
        "reached": "count(*) filter (where c or ap)", "reached_linked": "count(*) filter (where c and l)", "late": "count(*) filter (where (c and (late or ap)) or ap)", "late_linked": "count(*) filter (where c and (late or ap) and l)",
        "approved": "count(*) filter (where ap)", "reached_often": "count(*) filter (where c and n > 1)",
    }
    over = "reached/total reached/frequent reached_linked/linked reached_linked/frequent_linked late/total late/frequent late_linked/linked late_linked/frequent_linked approved/total approved/frequent".split()
    shares = ", ".join("round(coalesce(100.0::double * {0} / nullif({1}, 0), 0), 4) as pct_{0}_of_{1}".format(*x.split("/")) for x in over)
    return f", g as (select {', '.join(f'{v} as {k}' for k, v in n.items())} from {rows}) select *, {shares} from g"


def _ends(s, d):
    t = table(s, d, TR).where("merged_umls_label is not null and merged_mondo_label is not null")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    linked = lambda c: F.bool_or(F.coalesce(F.col(c), F.lit("-1")) != "-1")
    g = t.groupBy(term(F.col("merged_umls_label")).alias("drug"), term(F.col("merged_mondo_label")).alias("dis")).agg(
        F.sum(F.coalesce("preclinical_count", F.lit(0))).alias("n"), F.bool_or(F.coalesce("clinical_count", F.lit(0)) > 0).alias("clinical"), F.bool_or(yes("at_least_one_phase4") | yes("at_least_one_phase3")).alias("late"),
        F.bool_or(F.col("fda_earliest_year").isNotNull()).alias("approved"), linked("merged_umls_termid").alias("drug_linked"), linked("merged_mondo_termid").alias("disease_linked"),
    )
    return g.where("n > 0").withColumn("late", F.col("late") | F.col("approved"))


@query("a20_drug_reach", _ENDS + ", e as (select drug, sum(n) n, bool_or(c) c, bool_or(late and c) late, bool_or(ap) ap, bool_or(ld) l from f group by 1)" + _reach_sql("e", "n > 1 or c or ap"))
def _(s, d):
    e = _ends(s, d).groupBy("drug").agg(F.sum("n").alias("n"), F.bool_or("clinical").alias("clinical"), F.bool_or(F.col("late") & F.col("clinical")).alias("late"), F.bool_or("approved").alias("approved"), F.bool_or("drug_linked").alias("linked"))
    return T.reach(e.withColumn("late", F.col("late") | F.col("approved")), True)


@query("a21_pair_reach", _ENDS + ", e as (select *, ld and ls l from f)" + _reach_sql("e", "n > 1 or c"))
def _(s, d):
    return T.reach(_ends(s, d).withColumn("linked", F.col("drug_linked") & F.col("disease_linked")), False)


@query("a21_pair_reach_macro", _ENDS + """, g as (select drug, count(*) k, count(*) filter (where n > 1 or c) kf, count(*) filter (where c or ap) a1, count(*) filter (where (c or ap) and (n > 1 or c)) a2, count(*) filter (where (c and late) or ap) l1, count(*) filter (where ((c and late) or ap) and (n > 1 or c)) l2, count(*) filter (where ap) p1, count(*) filter (where ap and (n > 1 or c)) p2 from f group by 1)
select round(avg(100.0::double * a1 / k), 4) as macro_any_all, round(coalesce(avg(100.0::double * a2 / nullif(kf, 0)), 0), 4) as macro_any_frequent, round(avg(100.0::double * l1 / k), 4) as macro_late_all, round(coalesce(avg(100.0::double * l2 / nullif(kf, 0)), 0), 4) as macro_late_frequent, round(avg(100.0::double * p1 / k), 4) as macro_approved_all, round(coalesce(avg(100.0::double * p2 / nullif(kf, 0)), 0), 4) as macro_approved_frequent, count(*) as drugs_all, count(*) filter (where kf > 0) as drugs_frequent from g""")
def _(s, d):
    return T.reach_by_drug(_ends(s, d), "drug")


@query("a22_singleton_rule", _REACH + " select drug, dis, case when n > 1 then 'many' when c > 0 then 'one, clinical' else 'one, approved' end as kept from f where n > 1 or (n = 1 and c > 0) or (n = 1 and fda)")
def _(s, d):
    f = _reach(s, d).where("n > 1 or (n = 1 and c > 0) or (n = 1 and fda)")
    return f.select("drug", "dis", F.when(F.col("n") > 1, "many").when(F.col("c") > 0, "one, clinical").otherwise("one, approved").alias("kept"))


@query("a23_retrieval_coverage", f"with a as (select distinct {NUM} k from {ENT}), b as (select {NUM} k, source, text from documents where source <> 'pubmed_abstract'), g as (select k, count(*) filter (where text is not null and trim(text) <> '') n, bool_or(source = 'fulltext_xml' and text is not null) x from b where k is not null group by 1) select count(*) as wanted, count(g.k) as retrieved, count(*) filter (where n > 0) as with_text, count(*) filter (where x) as as_xml, count(*) - count(g.k) as missing, round(100.0::double * count(g.k) / count(*), 4) as percent_retrieved, round(100.0::double * count(*) filter (where n > 0) / count(*), 4) as percent_with_text, (select count(*) from g where k not in (select k from a where k is not null)) as not_wanted from a left join g using (k) where a.k is not null")
def _(s, d):
    """Wanted articles against full texts: one full join, so that what nobody wanted is counted too."""
    a = table(s, d, ENT).select(article(F.col("pmid")).alias("k")).where("k is not null").distinct().withColumn("want", F.lit(True))
    b = table(s, d, "documents").where("source <> 'pubmed_abstract'").select(article(F.col("pmid")).alias("k"), "source", "text").where("k is not null")
    some = F.col("text").isNotNull() & (F.trim("text") != "")
    g = b.groupBy("k").agg(F.count_if(some).alias("n"), F.bool_or((F.col("source") == "fulltext_xml") & F.col("text").isNotNull()).alias("x"))
    f = a.join(g, "k", "full")
    want, got = F.col("want").isNotNull(), F.col("n").isNotNull()
    c = f.agg(F.count_if(want).alias("wanted"), F.count_if(want & got).alias("retrieved"), F.count_if(want & (F.col("n") > 0)).alias("with_text"), F.count_if(want & F.coalesce("x", F.lit(False))).alias("as_xml"), F.count_if(want & ~got).alias("missing"), F.count_if(~want).alias("not_wanted"))
    share = lambda x: F.round(F.try_divide(100.0 * F.col(x), F.col("wanted")), 4)
    return c.select("*", share("retrieved").alias("percent_retrieved"), share("with_text").alias("percent_with_text"))


@query("a24_attrition_funnel", f"with k as (select distinct {NUM} k from {META} where {NUM} is not null), f as (select k, k in (select {NUM} from {ENT} where {NUM} is not null) e, k in (select {NUM} from {ANN} where {NUM} is not null) a, k in (select {NUM} from documents where {NUM} is not null) d from k), n as (select count(*) n0, count(*) filter (where e) n1, count(*) filter (where e and a) n2, count(*) filter (where e and a and d) n3 from f) select 1 as stage, 'entities' as name, n1 as kept, n0 - n1 as lost, round(n1::double / n0, 6) as fraction from n union all select 2, 'annotations', n2, n1 - n2, round(n2::double / n0, 6) from n union all select 3, 'documents', n3, n2 - n3, round(n3::double / n0, 6) from n")
def _(s, d):
    sets = {"m": META, "e": ENT, "a": ANN, "d": "documents"}
    f = R.overlap({n: table(s, d, t).select(article(F.col("pmid"))) for n, t in sets.items()}, "k").where("in_m")
    e, a, t = F.col("in_e"), F.col("in_a"), F.col("in_d")
    n = f.agg(F.count("*").alias("n0"), F.count_if(e).alias("n1"), F.count_if(e & a).alias("n2"), F.count_if(e & a & t).alias("n3"))
    rows = [F.struct(F.lit(i).alias("stage"), F.lit(x).alias("name"), F.col(f"n{i}").alias("kept"), (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("lost"), F.round(F.col(f"n{i}") / F.col("n0"), 6).alias("fraction")) for i, x in enumerate(["entities", "annotations", "documents"], 1)]
    return n.select(F.inline(F.array(*rows)))


_LINK = f"(select entity_row_id, string_split(drug_umls_term_norm, '|') a, string_split(drug_umls_termid, '|') b from {ENT})"


_MENTIONS = f"(select lower(trim(a[i])) x, trim(b[i]) id from {_LINK}, unnest(range(1, least(len(a), len(b)) + 1)) r(i) where a is not null and b is not null)"


@query("a25_linking_report", f"with m as (select x, id from {_MENTIONS} where x <> ''), t as (select x, count(*) n, bool_or(id <> '-1') up from m group by 1), c as (select id, count(*) n from m where id <> '-1' group by 1) select (select count(*) from m) as mentions, (select count(*) from m where id <> '-1') as linked_mentions, (select count(*) from t) as terms, (select count(*) from t where up) as linked_terms, (select count(*) from t where not up) as unlinked_terms, (select count(*) from t where n = 1) as singletons, (select count(*) from t where n = 1 and not up) as unlinked_singletons, (select count(*) from c) as concepts, round(100.0::double * (select count(*) from m where id <> '-1') / (select count(*) from m), 4) as percent_mentions_linked, round(100.0::double * (select count(*) from t where up) / (select count(*) from t), 4) as percent_terms_linked, round((select count(*) from t where up)::double / (select count(*) from c), 4) as terms_a_concept")
def _(s, d):
    """Mentions, terms and concepts, linked and not: pairs of term and id are counted first, so later steps see each pair once."""
    rows = table(s, d, ENT).select(F.arrays_zip(F.split("drug_umls_term_norm", r"\|").alias("a"), F.split("drug_umls_termid", r"\|").alias("b")).alias("z")).select(F.explode("z").alias("z"))
    pairs = rows.where("z.a is not null and z.b is not null").select(F.lower(F.trim("z.a")).alias("x"), F.trim("z.b").alias("id")).where("x <> ''").groupBy("x", "id").agg(F.count("*").alias("n"))
    up = F.col("id") != "-1"
    t = pairs.groupBy("x").agg(F.sum("n").alias("n"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("linked"), F.bool_or(up).alias("up"))
    g = t.agg(F.sum("n").alias("mentions"), F.sum("linked").alias("linked_mentions"), F.count("*").alias("terms"), F.count_if("up").alias("linked_terms"), F.count_if(~F.col("up")).alias("unlinked_terms"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if((F.col("n") == 1) & ~F.col("up")).alias("unlinked_singletons"))
    c = pairs.where(up).agg(F.countDistinct("id").alias("concepts"))
    share = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 4)
    return g.crossJoin(c).select("*", share("linked_mentions", "mentions").alias("percent_mentions_linked"), share("linked_terms", "terms").alias("percent_terms_linked"), F.round(F.try_divide(F.col("linked_terms").cast("double"), F.col("concepts")), 4).alias("terms_a_concept"))  # one row each


@query("a26_unlinked_singletons", f"with m as (select trim(unnest(a)) x, trim(unnest(b)) i from {_LINK} where len(a) = len(b)), c as (select x, count(*) n, bool_and(i = '-1') un from m group by 1) select count(*) filter (where un) as unlinked_terms, count(*) filter (where un and n = 1) as singletons, round(coalesce(100.0 * count(*) filter (where un and n = 1) / nullif(count(*) filter (where un), 0), 0), 4) as percent from c")
def _(s, d):
    rows, _ = C.aligned(table(s, d, ENT), ["drug_umls_term_norm", "drug_umls_termid"], ["entity_row_id"])
    c = rows.groupBy("drug_umls_term_norm").agg(F.count("*").alias("n"), F.bool_and(F.col("drug_umls_termid") == "-1").alias("un"))
    u = F.count_if("un")
    one = F.count_if(F.col("un") & (F.col("n") == 1))
    return c.agg(u.alias("unlinked_terms"), one.alias("singletons"), F.round(F.coalesce(F.try_divide(100.0 * one, u), F.lit(0.0)), 4).alias("percent"))


@query("a27_jaccard", f"with a as (select distinct {_T.format('merged_umls_label')} x from {TR} where merged_umls_label is not null), b as (select distinct lower(str) x from umls_concepts) select (select count(*) from a) as left_n, (select count(*) from b) as right_n, (select count(*) from a join b using (x)) as common, round((select count(*) from a join b using (x))::double / (select count(*) from (select x from a union select x from b)), 6) as jaccard")
def _(s, d):
    f = R.overlap({"a": table(s, d, TR).select(term(F.col("merged_umls_label"))), "b": table(s, d, "umls_concepts").select(F.lower("str"))}, "x")
    both = F.count_if(F.col("in_a") & F.col("in_b"))
    return f.agg(F.count_if("in_a").alias("left_n"), F.count_if("in_b").alias("right_n"), both.alias("common"), F.round(both / F.count("*"), 6).alias("jaccard"))


@query("a28_describe", f"select source, count(n_chars) as n, round(avg(n_chars), 4) as mean, median(n_chars)::double as median, round(stddev_samp(n_chars), 4) as sd, min(n_chars) as low, max(n_chars) as high from documents group by 1")
def _(s, d):
    g = table(s, d, "documents").groupBy("source")
    return g.agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.percentile("n_chars", F.lit(0.5)).alias("median"), F.round(F.stddev_samp("n_chars"), 4).alias("sd"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


_FOLDS = "(select source, fold, avg(len(tokens)) f from drug_disease_ner where tokens is not null group by 1, 2)"


@query("a29_fold_summary", f"select source, round(avg(f), 4) as mean, round(stddev_samp(f), 4) as sd, arg_min(fold, {{'d': round(abs(f - med), 6), 'k': fold}}) as median_fold, arg_max(fold, {{'f': f, 'k': fold}}) as best_fold from {_FOLDS} join (select source, median(f) med from {_FOLDS} group by 1) using (source) group by 1")
def _(s, d):
    f = table(s, d, "drug_disease_ner").where("tokens is not null").groupBy("source", "fold").agg(F.avg(F.size("tokens")).alias("f"))
    med = f.groupBy("source").agg(F.percentile("f", F.lit(0.5)).alias("med"))
    g = f.join(med, "source").groupBy("source")
    return g.agg(F.round(F.avg("f"), 4).alias("mean"), F.round(F.stddev_samp("f"), 4).alias("sd"), F.min_by("fold", F.struct(F.round(F.abs(F.col("f") - F.col("med")), 6), "fold")).alias("median_fold"), F.max_by("fold", F.struct("f", "fold")).alias("best_fold"))


_AVG_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query("a30_spearman", f"with r as (select {_AVG_RANK.format('articles')} a, {_AVG_RANK.format('species')} b, {_AVG_RANK.format('countries')} c from ({_HET.strip()[4:].join(['with ', ' select * from f'])})) select round(corr(a, b), 4) as articles_species, round(corr(a, c), 4) as articles_countries, round(corr(b, c), 4) as species_countries from r")
def _(s, d):
    """Ranks come from counts of distinct values, which are few, not from a global sort of rows."""
    f = heterogeneity(s, d).select("articles", "species", "countries")
    for c in ("articles", "species", "countries"):
        n = f.groupBy(c).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        f = f.join(n.select(c, (F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2).alias(f"r_{c}")), c)
    r = lambda x, y: F.round(F.corr(f"r_{x}", f"r_{y}"), 4)
    return f.agg(r("articles", "species").alias("articles_species"), r("articles", "countries").alias("articles_countries"), r("species", "countries").alias("species_countries"))


@query("a33_melt", f"select pair_row_id, metric, value from (select pair_row_id, clinical_count, preclinical_count, fda_earliest_year from {TR}) unpivot (value for metric in (clinical_count, preclinical_count, fda_earliest_year))")
def _(s, d):
    cols = ["clinical_count", "preclinical_count", "fda_earliest_year"]
    return table(s, d, TR).select("pair_row_id", *cols).unpivot(["pair_row_id"], cols, "metric", "value").where("value is not null")


@query("a34_trend_matrix", f"with n as (select year, animal_species, count(*) n from {ANN} where year is not null group by 1, 2), y as (select year, sum(n) t from n group by 1 having sum(n) >= 25), top as (select animal_species from {ANN} where animal_species is not null group by 1 order by count(*) desc, 1 limit 10) select year, animal_species, round(100.0 * n / t, 4) as percent from n join y using (year) where animal_species in (select * from top)")
def _(s, d):
    a = table(s, d, ANN)
    n = a.where("year is not null").groupBy("year", "animal_species").agg(F.count("*").alias("n"))
    y = n.groupBy("year").agg(F.sum("n").alias("t")).where("t >= 25")
    top = a.where("animal_species is not null").groupBy("animal_species").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "animal_species").limit(10).select("animal_species")
    return n.join(y, "year").join(top, "animal_species", "left_semi").select("year", "animal_species", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("percent"))


_FORMATS = f"(select {NUM} k, max((source = 'fulltext_xml')::int) x, max((source = 'fulltext_html')::int) h, max((source = 'fulltext_pdf')::int) p, max((source = 'plain')::int) t from documents group by 1)"


@query("a35_format_availability", f"select sum(x)::bigint as xml, sum(h)::bigint as html, sum(p)::bigint as pdf, sum(t)::bigint as plain, count(*) filter (where x = 1 and h + p + t = 0) as only_xml, count(*) filter (where x + h + p + t = 0) as none_at_all, round(avg(x + h + p + t), 6) as formats from {_FORMATS}")
def _(s, d):
    is_ = lambda v: F.max((F.col("source") == v).cast("int"))
    f = table(s, d, "documents").groupBy(article(F.col("pmid")).alias("k")).agg(is_("fulltext_xml").alias("x"), is_("fulltext_html").alias("h"), is_("fulltext_pdf").alias("p"), is_("plain").alias("t"))
    every = F.col("x") + F.col("h") + F.col("p") + F.col("t")
    return f.agg(F.sum("x").alias("xml"), F.sum("h").alias("html"), F.sum("p").alias("pdf"), F.sum("t").alias("plain"), F.count_if((F.col("x") == 1) & (every == 1)).alias("only_xml"), F.count_if(every == 0).alias("none_at_all"), F.round(F.avg(every), 6).alias("formats"))


@query("a36_phrase_summary", f"with m as (select {NUM} k, trim(regexp_extract(title, 'A model of (.+?) in (.+?) ([a-z ]+)\\.$', 1)) dis, regexp_extract(title, '(A model of) (.+?) in (.+?) ([a-z ]+)\\.$', 1) ph from {META}), g as (select dis, ph, k from m where ph <> '' and k is not null group by 1, 2, 3) select dis as disease, ph as phrase, count(*) as docs, string_agg(k::varchar, '|' order by k) filter (where r <= 3) as examples from (select *, row_number() over (partition by dis, ph order by k) r from g) group by 1, 2")
def _(s, d):
    """Articles of each disease and phrase, and three of them. A phrase of many articles is counted in parts, of which each keeps three."""
    p = r"(A model of) (.+?) in (.+?) ([a-z ]+)\.$"
    m = table(s, d, META).select(article(F.col("pmid")).alias("k"), F.trim(F.regexp_extract("title", p, 2)).alias("disease"), F.regexp_extract("title", p, 1).alias("phrase")).where("phrase <> '' and k is not null").distinct()
    part = m.groupBy("disease", "phrase", F.pmod(F.xxhash64("k"), F.lit(width(s))).alias("part")).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("k")), 1, 3).alias("k"))
    three = F.slice(F.array_sort(F.flatten(F.collect_list("k"))), 1, 3)
    return part.groupBy("disease", "phrase").agg(F.sum("n").alias("docs"), F.array_join(F.transform(three, lambda x: x.cast("string")), "|").alias("examples"))


@query("a35_formats_by_year", "select year(loaded_at)::int as year, count(*) as documents, round(avg((source = 'fulltext_xml')::int), 6) as xml, round(avg((source = 'fulltext_html')::int), 6) as html, round(avg((source = 'fulltext_pdf')::int), 6) as pdf, round(avg((source = 'plain')::int), 6) as plain from documents where loaded_at is not null and source is not null group by 1")
def _(s, d):
    share = lambda v: F.round(F.avg((F.col("source") == v).cast("int")), 6)
    t = table(s, d, "documents").where("loaded_at is not null and source is not null")
    return t.groupBy(F.year("loaded_at").alias("year")).agg(F.count("*").alias("documents"), share("fulltext_xml").alias("xml"), share("fulltext_html").alias("html"), share("fulltext_pdf").alias("pdf"), share("plain").alias("plain"))


@query("a35_formats_by_journal", "select lower(trim(journal_name)) as journal, count(*) as documents, count(*) filter (where source like 'fulltext%') as full_texts, round(avg((source like 'fulltext%')::int), 6) as share from documents where trim(journal_name) <> '' and source is not null group by 1")
def _(s, d):
    t = table(s, d, "documents").where("trim(journal_name) <> '' and source is not null").withColumn("full", F.col("source").startswith("fulltext"))
    return t.groupBy(F.lower(F.trim("journal_name")).alias("journal")).agg(F.count("*").alias("documents"), F.count_if("full").alias("full_texts"), F.round(F.avg(F.col("full").cast("int")), 6).alias("share"))


@query("f50_pipe_tokens", f"select entity_row_id, len([x for x in string_split(unique_conditions_linkbert_predictions, '|') if trim(x) <> '']) as n from {ENT} where unique_conditions_linkbert_predictions is not null")
def _(s, d):
    return table(s, d, ENT).where("unique_conditions_linkbert_predictions is not null").select("entity_row_id", F.size(C.tokens(F.col("unique_conditions_linkbert_predictions"))).cast("bigint").alias("n"))


@query("f51_aligned_explode", f"select entity_row_id, i::int as pos, trim(a[i]) as drug_umls_term_norm, trim(b[i]) as drug_umls_termid from {_LINK}, unnest(range(1, len(a) + 1)) r(i) where len(a) = len(b)")
def _(s, d):
    return C.aligned(table(s, d, ENT), ["drug_umls_term_norm", "drug_umls_termid"], ["entity_row_id"])[0]


@query("f52_cartesian_pairs", f"select entity_row_id, trim(x) as disease, trim(y) as drug from {ENT}, unnest(string_split(disease_mondo_term_norm, '|')) as p(x), unnest(string_split(drug_umls_term_norm, '|')) as q(y) where trim(x) <> '' and trim(y) <> ''")
def _(s, d):
    t = table(s, d, ENT).select("entity_row_id", C.tokens(F.col("disease_mondo_term_norm")).alias("a"), C.tokens(F.col("drug_umls_term_norm")).alias("b"))
    return t.select("entity_row_id", "b", F.explode("a").alias("disease")).select("entity_row_id", "disease", F.explode("b").alias("drug"))


@query("f54_union_cells", f"select entity_row_id, list_aggregate(list_sort(list_distinct([trim(x) for x in string_split(coalesce(disease_mondo_term_norm, '') || '|' || coalesce(drug_umls_term_norm, ''), '|') if trim(x) <> ''])), 'string_agg', '|') as cell from {ENT} where disease_mondo_term_norm is not null and drug_umls_term_norm is not null")
def _(s, d):
    return table(s, d, ENT).where("disease_mondo_term_norm is not null and drug_umls_term_norm is not null").select("entity_row_id", C.union_cell(F.col("disease_mondo_term_norm"), F.col("drug_umls_term_norm")).alias("cell"))


_RANK = "case replace(upper({0}), ' ', '') when 'EARLY_PHASE1' then 0.0 when 'EARLYPHASE1' then 0.0 when 'PHASE1' then 1.0 when 'PHASE1/PHASE2' then 1.5 when 'PHASE2' then 2.0 when 'PHASE2/PHASE3' then 2.5 when 'PHASE3' then 3.0 when 'PHASE4' then 4.0 else -1.0 end"


@query("f56_max_phase", f"select pair_row_id, coalesce(max({_RANK.format('p')}), -1.0)::double as max_phase from (select pair_row_id, unnest(case when len(phase) = 0 or phase is null then [null] else phase end) p from {TR}) group by 1")
def _(s, d):
    return table(s, d, TR).select("pair_row_id", T.max_phase(F.col("phase")).alias("max_phase"))


@query("f57_first_years", f"with z as (select pair_row_id, unnest(range(1, len(phase) + 1)) i, phase, overall_status, trial_start_year, final_trial_year from {TR}), t as (select pair_row_id, replace(upper(phase[i]), ' ', '') p, upper(trim(overall_status[i])) s, trial_start_year[i] a, final_trial_year[i] b from z) select pair_row_id, min(a) filter (where list_contains(string_split(p, '/'), 'PHASE4')) as first_phase4, min(b) filter (where list_contains(string_split(p, '/'), 'PHASE3') and s = 'COMPLETED') as first_completed_phase3 from t group by 1")
def _(s, d):
    return T.milestones(table(s, d, TR)).where(F.size("phase") > 0).select("pair_row_id", "first_phase4", "first_completed_phase3")


@query("f58_docs_by_cutoff", f"select pair_row_id, len([y for y in pub_year if y <= 2010]) as docs from {TR} where pub_year is not null")
def _(s, d):
    return table(s, d, TR).where("pub_year is not null").select("pair_row_id", F.size(F.filter("pub_year", lambda y: y <= 2010)).cast("bigint").alias("docs"))


@query("f37_safe_percent", f"select pair_row_id, coalesce(100.0::double * clinical_count / nullif(preclinical_count, 0), 0) as percent from {TR}")
def _(s, d):
    return table(s, d, TR).select("pair_row_id", F.coalesce(F.try_divide(100.0 * F.col("clinical_count"), F.col("preclinical_count")), F.lit(0.0)).alias("percent"))


@query("f38_count_format", f"select animal_sex, printf('%d (%.1f%%)', n, p) as cell, n as parsed from (select animal_sex, count(*) n, 100.0::double * count(*) / sum(count(*)) over () p from {ANN} group by 1)")
def _(s, d):
    n = R.share(table(s, d, ANN).groupBy("animal_sex").agg(F.count("*").alias("n")), "n", 10)
    cell = F.format_string("%d (%.1f%%)", "n", "percent")
    return n.select("animal_sex", cell.alias("cell"), F.regexp_extract(cell, r"^(\d+)", 1).cast("bigint").alias("parsed"))


@query("f39_date_year", "select event_id, year(try_cast(case when event_id % 5 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as date))::int as y from events")
def _(s, d):
    text = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(s, d, "events").select("event_id", F.year(F.try_to_date(text)).alias("y"))


@query("f40_before_after", f"select pair_row_id, len([y for y in pub_year if y < fda_earliest_year]) as before, len([y for y in pub_year if y >= fda_earliest_year]) as after from {TR} where fda_earliest_year is not null and pub_year is not null")
def _(s, d):
    t = table(s, d, TR).where("fda_earliest_year is not null and pub_year is not null")
    n = lambda f: F.size(F.filter("pub_year", f)).cast("bigint")
    return t.select("pair_row_id", n(lambda y: y < F.col("fda_earliest_year")).alias("before"), n(lambda y: y >= F.col("fda_earliest_year")).alias("after"))


@query("f41_scale", "select p_partkey, round((p_retailprice - m) / sd, 6) as z from part, (select avg(p_retailprice) m, stddev_samp(p_retailprice) sd from part)")
def _(s, d):
    p = table(s, d, "part")
    st = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("sd"))
    return p.crossJoin(F.broadcast(st)).select("p_partkey", F.round((F.col("p_retailprice") - F.col("m")) / F.col("sd"), 6).alias("z"))  # one row


@query("t06_year_matrix", f"with y as (select normalized_key pair, unnest(pub_year) y from {TR} where normalized_key is not null) select pair, count(*) filter (where y < 1990) as before_1990, count(*) filter (where y between 1990 and 1999) as y1990, count(*) filter (where y between 2000 and 2009) as y2000, count(*) filter (where y >= 2010) as since_2010 from y group by 1")
def _(s, d):
    y = table(s, d, TR).where("normalized_key is not null").select(F.col("normalized_key").alias("pair"), F.explode("pub_year").alias("y"))
    era = F.when(F.col("y") < 1990, "before_1990").when(F.col("y") < 2000, "y1990").when(F.col("y") < 2010, "y2000").when(F.col("y") >= 2010, "since_2010")
    return y.withColumn("era", era).groupBy("pair").pivot("era", ["before_1990", "y1990", "y2000", "since_2010"]).count().na.fill(0)

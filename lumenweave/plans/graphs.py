"""Queries over the term graph, linking, evaluation and statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenweave.functions import biology as B
from lumenweave.functions import cells as C
from lumenweave.functions.text import article
from lumenweave.operators import classify as K
from lumenweave.operators import evaluate as E
from lumenweave.operators import linking as L
from lumenweave.operators import ontology as G
from lumenweave.plans.aggregates import heterogeneity
from lumenweave.plans.registry import Registry
from lumenweave.plans.training import ANNOTATIONS as ANN
from lumenweave.plans.training import ENTITIES as ENT
from lumenweave.plans.training import METADATA as META
from lumenweave.plans.training import _NUMBER as NUM
from lumenweave.session import table

TR, NER = "translation_table_drug_disease_full", "drug_disease_ner"
query = Registry()

_UP = "with recursive e as (select distinct id c, p from (select id, unnest(parents) p from ontology_terms) where id <> p), walk as (select c node, p ancestor, 1 hops from e union select w.node, e.p, w.hops + 1 from walk w join e on w.ancestor = e.c where w.hops < 30), up as (select node, ancestor, min(hops) hops from walk where node <> ancestor group by 1, 2)"
#: The root is the node without parents at which the most links end.
_ROOT = "(select p from (select id, unnest(parents) p from ontology_terms) where p not in (select id from ontology_terms where len(parents) > 0) group by 1 order by count(*) desc, p limit 1)"


def _closure(s, d):
    return G.closure(G.edges(table(s, d, "ontology_terms")))


def _root(s, d):
    return G.root_of(G.edges(table(s, d, "ontology_terms")))


@query("g01_ancestor_closure", _UP + " select node, ancestor, hops::int as hops from up")
def _(s, d):
    return _closure(s, d)


@query("g02_depth_to_root", _UP + f" select node, hops::int as depth from up where ancestor = {_ROOT}")
def _(s, d):
    return G.depths(_closure(s, d), _root(s, d))


@query("g03_descendant_counts", _UP + " select ancestor as node, count(distinct node) as descendants from up group by 1")
def _(s, d):
    return G.descendants(_closure(s, d))


_USED = f"used as (select distinct trim(unnest(string_split(disease_mondo_termid, '|'))) id from {ENT})"
_NEAR = f", {_USED}, few as (select ancestor from up group by 1 having count(distinct node) < 100), deep as (select node from up where ancestor = {_ROOT} and hops >= 1)"


def _used(s, d):
    return table(s, d, ENT).select(F.explode(C.tokens(F.col("disease_mondo_termid"))).alias("id")).distinct()


@query("g04_nearest_parent", _UP + _NEAR + " select node, split_part(b, '#', 2) as parent, split_part(b, '#', 1)::int as hops from (select node, min(lpad(hops::varchar, 3, '0') || '#' || ancestor) b from up where ancestor in (select id from used where id is not null) and ancestor in (select * from few) and ancestor in (select * from deep) group by 1)")
def _(s, d):
    up = _closure(s, d)
    return G.nearest_parent(up, _used(s, d), G.depths(up, _root(s, d)), 1, 100)


@query("g05_all_parents", _UP + f", {_USED}, few as (select ancestor from up group by 1 having count(distinct node) between 1 and 50) select node, string_agg(ancestor, '|' order by ancestor) as parents from up where ancestor in (select id from used where id is not null) and ancestor in (select * from few) group by 1")
def _(s, d):
    up = _closure(s, d)
    few = G.descendants(up).where("descendants between 1 and 50").select(F.col("node").alias("ancestor"))
    fit = up.join(few, "ancestor", "left_semi").join(_used(s, d).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return fit.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("ancestor")), "|").alias("parents"))


@query("g06_parent_stats", "select p as parent, count(*) as n, string_agg(id, '|' order by id) as children from (select id, unnest(parents) p from ontology_terms) group by 1")
def _(s, d):
    e = G.edges(table(s, d, "ontology_terms"))
    return e.groupBy("parent").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("child")), "|").alias("children"))


@query("g07_lowest_common_ancestor", _UP + f""", grp as (select distinct entity_row_id g, trim(unnest(string_split(disease_mondo_termid, '|'))) node from {ENT}),
grps as (select g, node from grp where node not in ('', '-1')), anc as (select g, grps.node, ancestor from grps join up on up.node = grps.node union select g, node, node from grps),
ok as (select g, ancestor from anc group by 1, 2 having count(distinct node) = (select count(*) from grps x where x.g = anc.g)),
deep as (select node, hops from up where ancestor = {_ROOT})
select g as grp, arg_max(ok.ancestor, {{'d': coalesce(hops, 0), 'a': ok.ancestor}}) as common from ok left join deep on deep.node = ok.ancestor group by 1""")
def _(s, d):
    up = _closure(s, d)
    groups = table(s, d, ENT).select(F.col("entity_row_id").alias("grp"), F.explode(C.tokens(F.col("disease_mondo_termid"))).alias("node")).where("node <> '-1'").distinct()
    return G.lowest_common(up, groups, G.depths(up, _root(s, d)))


_PIECES = f"""with l as (select entity_row_id, string_split(coalesce(disease_mondo_termid, ''), '|') i, string_split(coalesce(disease_mondo_term_norm, ''), '|') n, string_split(coalesce(nearest_dataset_parent_label, ''), '|') p from {ENT}),
names as (select lower(trim(name)) k, min(id) id from ontology_terms group by 1),
own as (select entity_row_id, pos, coalesce(trim(i[pos]), '') id, coalesce(trim(n[pos]), '') label from l, unnest(range(1, greatest(len(i), len(n)) + 1)) r(pos)),
own1 as (select entity_row_id, id, min(pos) pos, arg_min(label, pos) as label from own where id <> '' or label <> '' group by entity_row_id, id, lower(label)),
up as (select entity_row_id, pos, coalesce(names.id, '-1') id, label from (select entity_row_id, pos, trim(p[pos]) as label from l, unnest(range(1, len(p) + 1)) r(pos)) left join names on lower(label) = k where label not in ('', '-1')),
up1 as (select entity_row_id, id, min(pos) pos, arg_min(label, pos) as label from up where not exists (select 1 from own1 o where o.entity_row_id = up.entity_row_id and o.id = up.id and (up.id <> '-1' or lower(o.label) = lower(up.label))) group by entity_row_id, id, case when id = '-1' then lower(label) end),
merged as (select *, 1 as side from own1 union all select *, 2 from up1)"""


@query("f55_merged_lists", _PIECES + " select entity_row_id, coalesce(string_agg(m.id, '|' order by side, pos), '') as ids, coalesce(string_agg(m.label, '|' order by side, pos), '') as labels from l left join merged m using (entity_row_id) group by 1")
def _(s, d):
    """Ids and labels of every row with those of its parents: own ones once by (id, lower label), then parents whose id is not there yet.

    The table names parents by label; their ids are those of the ontology. One that the ontology doesn't have keeps its label, with ``-1``.
    """
    names = table(s, d, "ontology_terms").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("pid"))
    t = table(s, d, ENT).select("entity_row_id", *[F.split(F.coalesce(c, F.lit("")), r"\|").alias(a) for c, a in (("disease_mondo_termid", "i"), ("disease_mondo_term_norm", "n"), ("nearest_dataset_parent_label", "p"))])
    flat = t.select("entity_row_id", F.posexplode("p").alias("pos", "x")).select("entity_row_id", "pos", F.trim("x").alias("label")).where("label not in ('', '-1')")
    named = flat.withColumn("k", F.lower("label")).join(names, "k", "left").withColumn("id", F.coalesce("pid", F.lit("-1")))
    key = F.struct("id", F.when(F.col("id") == "-1", F.col("k")).otherwise("").alias("k"))
    up = named.groupBy("entity_row_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("id", "label", key.alias("key")).alias("v")))).alias("up"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit("")))
    own = F.transform(F.arrays_zip("i", "n"), lambda x: F.struct(blank(x["i"]).alias("id"), blank(x["n"]).alias("label"), F.struct(blank(x["i"]).alias("id"), F.lower(blank(x["n"])).alias("k")).alias("key")))
    none = F.filter(own, lambda x: F.lit(False))
    t = t.select("entity_row_id", C.ordered_union(F.filter(own, lambda x: (x["id"] != "") | (x["label"] != "")), none, "key").alias("own")).join(up, "entity_row_id", "left")
    there = lambda x: F.exists("own", lambda y: (y["id"] == x["id"]) & ((x["id"] != "-1") | (y["key"]["k"] == x["key"]["k"])))
    added = F.filter(F.coalesce(F.col("up.v"), F.filter("own", lambda x: F.lit(False))), lambda x: ~there(x))
    both = F.concat("own", C.ordered_union(added, F.filter("own", lambda x: F.lit(False)), "key"))
    return t.select("entity_row_id", F.array_join(both["id"], "|").alias("ids"), F.array_join(both["label"], "|").alias("labels"))


_ROOTS = "(select id, name, regexp_replace(lower(name), '(,? type \\d+|, severe form|, autosomal, early| \\(late stage\\))$', '') root from ontology_terms)"


@query("j17_root_groups", f"select root, count(*) as members, arg_min(id, {{'own': (lower(name) <> root)::int, 'id': id}}) as group_id from {_ROOTS} group by 1 having count(*) >= 2")
def _(s, d):
    t = table(s, d, "ontology_terms").select("id", "name", F.regexp_replace(F.lower("name"), r"(,? type \d+|, severe form|, autosomal, early| \(late stage\))$", "").alias("root"))
    g = t.groupBy("root").agg(F.count("*").alias("members"), F.min_by("id", F.struct((F.lower("name") != F.col("root")).cast("int"), "id")).alias("group_id"))
    return g.where("members >= 2")


@query("j09_dictionary_lookup", f"with n as (select distinct lower(trim(v)) k, c from (select str v, cui c from umls_concepts)), m as (select entity_row_id, trim(unnest(string_split(drug_umls_term_norm, '|'))) term from {ENT}) select entity_row_id, term, coalesce(c, lower(trim(term))) as canonical from m left join n on lower(trim(term)) = k where term <> ''")
def _(s, d):
    names = table(s, d, "umls_concepts").select(F.col("str").alias("variant"), F.col("cui").alias("canonical"))
    m = table(s, d, ENT).select("entity_row_id", F.explode(C.tokens(F.col("drug_umls_term_norm"))).alias("term"))
    return L.dictionary_lookup(m, "term", names).select("entity_row_id", "term", "canonical")


@query("j09_relinked_cells", f"with n as (select lower(trim(str)) k, array_to_string(list_sort(list_distinct(list(cui))), ',') c from umls_concepts group by 1), m as (select entity_row_id, i, lower(trim(a[i])) t from (select entity_row_id, string_split(drug_umls_term_norm, '|') a from {ENT} where drug_umls_term_norm is not null), unnest(range(1, len(a) + 1)) r(i)) select entity_row_id, string_agg(coalesce(c, t), '|' order by i) as ids from m left join n on t = k where t <> '' group by 1")
def _(s, d):
    """Each cell with the ids of its terms in their places; several ids of a term are joined by a comma, an unknown term stays."""
    names = table(s, d, "umls_concepts").groupBy(F.lower(F.trim("str")).alias("t")).agg(F.array_join(F.array_sort(F.collect_set("cui")), ",").alias("c"))
    m = table(s, d, ENT).where("drug_umls_term_norm is not null").select("entity_row_id", F.posexplode(F.split(F.lower("drug_umls_term_norm"), r"\|")).alias("i", "t")).withColumn("t", F.trim("t")).where("t <> ''")
    parts = F.sort_array(F.collect_list(F.struct("i", F.coalesce("c", "t").alias("v"))))
    return m.join(names, "t", "left").groupBy("entity_row_id").agg(F.array_join(parts["v"], "|").alias("ids"))


@query("j10_map_enrich", f"select a.annotation_row_id, s.strainname as strain from {ANN} a left join (select lower(synonym) k, min(strainname) strainname from strain_synonyms group by 1) s on lower(trim(a.animal_strain)) = k")
def _(s, d):
    n = table(s, d, "strain_synonyms").groupBy(F.lower("synonym").alias("k")).agg(F.min("strainname").alias("strain"))
    return table(s, d, ANN).withColumn("k", F.lower(F.trim("animal_strain"))).join(n, "k", "left").select("annotation_row_id", "strain")


@query("f14_strain_family", rf"""with t as (select annotation_row_id, trim(animal_strain) o, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(animal_strain)), '-?TG\([^)]*\).*', ''), '\([^)]*\)', '', 'g'), '[^A-Z0-9/\s_-]', ' ', 'g'), '[\s_-]+', '', 'g') m,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(animal_strain), '(?i)-?Tg\([^)]*\).*', ''), '\([^)]*\)', '', 'g'), '[^A-Za-z0-9/\s_-]', ' ', 'g'), '[\s_-]+', '', 'g') f from {ANN} where trim(animal_strain) <> ''),
u as (select annotation_row_id, o, regexp_replace(m, '/+', '/', 'g') m, regexp_replace(regexp_replace(f, '/+', '/', 'g'), '/[A-Za-z]+$', '') f from t)
select annotation_row_id, case when upper(o) in ('NOT REPORTED', 'UNLABELED', 'NAN', 'NONE', 'OTHER') then o
when regexp_matches(m, '^C57/?B?L?/?\d') then 'C57BL/' || regexp_extract(m, '^C57/?B?L?/?(\d+)', 1) when regexp_matches(m, '^BALB/?C([^A-Z0-9_]|$)') then 'BALB/C' when regexp_matches(m, '^DBA/?\d') then 'DBA/' || regexp_extract(m, '^DBA/?(\d+)', 1)
when m like 'FVB%' then 'FVB/N' when m like '129%' then '129' when regexp_matches(m, '^(CBA|NOD|C3H)(/[A-Z0-9]+)?$') then m[1:3] when regexp_matches(m, '^SJL(/[A-Z0-9]*)?$') then 'SJL'
when regexp_matches(m, '^SPRAGUE[A-Z]{{0,6}}DAWLE?Y') then 'Sprague-Dawley' when m like 'WISTAR%' then 'Wistar' when regexp_matches(m, '^LONG[A-Z]{{0,6}}EVA[NS]{{1,2}}') then 'Long-Evans' when regexp_matches(m, '^(FISCHE?R?344|F344)') then 'Fischer' when regexp_matches(m, '^(LEWIS$|LEW($|[^A-Z]))') then 'Lewis' when m like 'SWISSALBINO%' then 'Swiss Albino'
when regexp_matches(f, '^[^/]+/[^/]+') then regexp_extract(f, '^([^/]+/[^/]+)', 1) else f end as strain from u""")
def _(s, d):
    return table(s, d, ANN).where("trim(animal_strain) <> ''").select("annotation_row_id", B.strain_family(F.col("animal_strain")).alias("strain"))


_VEC = "(select vec_id, embedding::double[] e, label from embeddings)"


@query("j11_nearest_neighbours", f"select query_id, base_id, round(dist, 4) as distance, r::int as rank from (select *, row_number() over (partition by query_id order by dist, base_id) r from (select q.vec_id query_id, b.vec_id base_id, list_distance(q.e, b.e) dist from {_VEC} q, {_VEC} b where q.vec_id % 50 = 0 and b.vec_id <> q.vec_id)) where r <= 3")
def _(s, d):
    """The queries are the rows whose id is divisible by 50, a stated query set, against all rows."""
    v = table(s, d, "embeddings")
    return L.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 3).select("query_id", "base_id", F.round("distance", 4).alias("distance"), "rank")


@query("e07_threshold_sweep", f"with n as (select query_id, (select label from embeddings where vec_id = query_id) = (select label from embeddings where vec_id = base_id) ok, dist from (select *, row_number() over (partition by query_id order by dist, base_id) r from (select q.vec_id query_id, b.vec_id base_id, list_distance(q.e, b.e) dist from {_VEC} q, {_VEC} b where q.vec_id % 50 = 0 and b.vec_id <> q.vec_id)) where r = 1), t as (select unnest([6.0, 7.0, 8.0, 9.0, 10.0])::double threshold), c as (select threshold, count(*) filter (where dist <= threshold and ok) tp, count(*) filter (where dist <= threshold and not ok) fp, count(*) filter (where dist > threshold and ok) fn from n, t group by 1) select threshold, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c")
def _(s, d):
    v = table(s, d, "embeddings")
    near = L.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 1)
    label = lambda n: v.select(F.col("vec_id").alias(n), F.col("label").alias(f"l_{n}"))
    linked = near.join(label("query_id"), "query_id").join(label("base_id"), "base_id").withColumn("ok", F.col("l_query_id") == F.col("l_base_id"))
    return E.sweep(linked, "distance", "ok", [6.0, 7.0, 8.0, 9.0, 10.0])


@query("j12_near_strains", f"with a as (select distinct lower(trim(animal_strain)) a from {ANN} where trim(animal_strain) <> ''), b as (select distinct lower(synonym) b from strain_synonyms), p as (select a, b, 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) s from a, b where least(length(a), length(b)) >= 0.8 * greatest(length(a), length(b))) select a as name, arg_min(b, {{'s': -s, 'b': b}}) as match, round(max(s), 6) as score from p where s >= 0.8 group by 1")
def _(s, d):
    a = table(s, d, ANN).select(F.lower(F.trim("animal_strain")).alias("name"))
    b = table(s, d, "strain_synonyms").select(F.lower("synonym").alias("name"))
    return L.near_strings(a, b, 0.8).withColumn("score", F.round("score", 6))


@query("j13_block_ratio")
def _(s, d):
    a = table(s, d, TR).select(F.lower(F.trim("merged_umls_label")).alias("name"))
    b = table(s, d, "umls_concepts").select(F.lower("str").alias("name"))
    return L.near_blocks(a, b, 0.85).withColumn("ratio", F.round("ratio", 6))



@query("j14_title_similarity", f"with m as (select {NUM} k, meta_row_id i, lower(title) t from {META} where title is not null) select a.i as row_a, b.i as row_b, round(1 - levenshtein(a.t, b.t)::double / greatest(length(a.t), length(b.t)), 6) as score from m a join m b on a.k = b.k and a.i < b.i where 1 - levenshtein(a.t, b.t)::double / greatest(length(a.t), length(b.t)) >= 0.9")
def _(s, d):
    """Versions of an article whose titles are alike. Rows without a readable article number meet nothing."""
    m = table(s, d, META).where("title is not null").select(article(F.col("pmid")).alias("k"), F.col("meta_row_id").alias("i"), F.lower("title").alias("t")).where("k is not null")
    a, b = m.toDF("k", "row_a", "ta"), m.toDF("k", "row_b", "tb")
    score = L.similarity(F.col("ta"), F.col("tb"))
    return a.join(b, "k").where((F.col("row_a") < F.col("row_b")) & (score >= 0.9)).select("row_a", "row_b", F.round(score, 6).alias("score"))


# What annotators say of blinding against what the article's texts say.
_PRED = f"(select case when lower(trim(rigor_blinding)) = 'reported' then 'reported' else 'not reported' end t, case when regexp_matches(lower(text), 'blind') then 'reported' else 'not reported' end s from (select {NUM} k, rigor_blinding from {ANN}) a join (select {NUM} k, text from documents where text is not null) b using (k))"


def _pred(s, d):
    word = lambda c: F.when(c, "reported").otherwise("not reported")
    notes = table(s, d, ANN).select(article(F.col("pmid")).alias("k"), "annotation_row_id", word(F.lower(F.trim("rigor_blinding")) == "reported").alias("t"))
    texts = table(s, d, "documents").where("text is not null").select(article(F.col("pmid")).alias("k"), "doc_id", word(K.blinding(F.col("text")) == 1).alias("s"))
    return notes.join(texts, "k")


@query("e02_label_scores", f"with l as (select t x from {_PRED} union select s from {_PRED}), c as (select x, count(*) filter (where t = x and s = x) tp, count(*) filter (where t <> x and s = x) fp, count(*) filter (where t = x and s <> x) fn from l, {_PRED} p group by 1) select x as label, tp + fn as support, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c")
def _(s, d):
    return E.by_label(_pred(s, d), "t", "s")


@query("e02_weighted_scores", f"with l as (select t x from {_PRED} union select s from {_PRED}), c as (select x, count(*) filter (where t = x and s = x) tp, count(*) filter (where t <> x and s = x) fp, count(*) filter (where t = x and s <> x) fn from l, {_PRED} p group by 1), r as (select tp + fn w, coalesce(tp::double / nullif(tp + fp, 0), 0) p, coalesce(tp::double / nullif(tp + fn, 0), 0) r, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) f from c) select sum(w)::bigint as support, round(sum(p * w) / sum(w), 5) as precision, round(sum(r * w) / sum(w), 5) as recall, round(sum(f * w) / sum(w), 5) as f1 from r")
def _(s, d):
    """Means of the labels' scores, weighted by their support."""
    w = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 5).alias(c)
    return E.by_label(_pred(s, d), "t", "s").agg(F.sum("support").alias("support"), w("precision"), w("recall"), w("f1"))


_LISTS = f"(select string_split(unique_interventions_linkbert_predictions, '|') p, string_split(drug_umls_term_norm, '|') t from {ENT} where unique_interventions_linkbert_predictions is not null and drug_umls_term_norm is not null)"


@query("e03_multilabel", f"with x as (select list_distinct(t) t, list_distinct(p) p from {_LISTS}), y as (select len(list_intersect(t, p)) tp, len(p) - len(list_intersect(t, p)) fp, len(t) - len(list_intersect(t, p)) fn from x) select count(*) as n, round(sum(tp)::double / (sum(tp) + sum(fp)), 6) as precision, round(sum(tp)::double / (sum(tp) + sum(fn)), 6) as recall, round(2.0::double * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as f1, round(avg((fp + fn = 0)::int), 6) as subset_accuracy, round(avg(tp::double / (tp + fp + fn)), 6) as jaccard, round(avg((tp > 0)::int), 6) as any_overlap from y")
def _(s, d):
    t = table(s, d, ENT).select(F.split("drug_umls_term_norm", r"\|").alias("t"), F.split("unique_interventions_linkbert_predictions", r"\|").alias("p"))
    return E.multilabel(t, "t", "p")


@query("e03_averages", f"with x as (select list_distinct(t) t, list_distinct(p) p from {_LISTS}), l as (select unnest(list_distinct(list_concat(t, p))) l, t, p from x), g as (select l, count(*) filter (where list_contains(t, l) and list_contains(p, l)) tp, count(*) filter (where not list_contains(t, l)) fp, count(*) filter (where not list_contains(p, l)) fn from l group by 1), s as (select tp + fn w, coalesce(tp::double / nullif(tp + fp, 0), 0) p, coalesce(tp::double / nullif(tp + fn, 0), 0) r, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) f from g) select 'macro' as average, count(*) as labels, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(f), 6) as f1 from s union all select 'weighted', count(*), round(sum(p * w) / sum(w), 6), round(sum(r * w) / sum(w), 6), round(sum(f * w) / sum(w), 6) from s")
def _(s, d):
    t = table(s, d, ENT).select(F.split("drug_umls_term_norm", r"\|").alias("t"), F.split("unique_interventions_linkbert_predictions", r"\|").alias("p"))
    return E.multilabel_averages(t, "t", "p")


@query("e04_confusion", f"select t, count(*) filter (where s = 'reported') as reported, count(*) filter (where s = 'not reported') as not_reported from {_PRED} group by 1")
def _(s, d):
    return _pred(s, d).groupBy("t").pivot("s", ["reported", "not reported"]).count().na.fill(0).withColumnRenamed("not reported", "not_reported")


@query("e05_keyword_scores", "with c as (select contains(lower(text), 'blind') p, contains(lower(text), 'observer') t from documents where text is not null), n as (select count(*) filter (where p and t) tp, count(*) filter (where p and not t) fp, count(*) filter (where t and not p) fn from c) select tp, fp, fn, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from n")
def _(s, d):
    t = table(s, d, "documents").where("text is not null").select(F.contains(F.lower("text"), F.lit("blind")).alias("p"), F.contains(F.lower("text"), F.lit("observer")).alias("t"))
    n = t.agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    return n.select("tp", "fp", "fn", *E.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query("e06_numeric_errors", f"select count(*) as n, count(*) filter (where p = t) as exact, round(avg(abs(p - t)), 6) as mean_error, round(avg(abs(p - t)::double / nullif(t, 0)), 6) as relative_error from (select len(preclinical_doc_ids) p, preclinical_count t from {TR} where preclinical_count is not null and preclinical_doc_ids is not null)")
def _(s, d):
    t = table(s, d, TR).where("preclinical_count is not null and preclinical_doc_ids is not null").select(F.size("preclinical_doc_ids").alias("p"), F.col("preclinical_count").alias("t"))
    e = F.abs(F.col("p") - F.col("t"))
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("t")).alias("exact"), F.round(F.avg(e), 6).alias("mean_error"), F.round(F.avg(F.try_divide(e, F.col("t"))), 6).alias("relative_error"))


@query("e09_mapping_statistics", f"with m as (select lower(trim(unnest(string_split(unique_interventions_linkbert_predictions, '|')))) t from {ENT}), n as (select count(*) processed, count(*) filter (where t in (select lower(trim(str)) from umls_concepts)) matched from m where t not in ('', 'none', 'none.')) select processed, matched, round(100.0::double * matched / processed, 4) as percent from n")
def _(s, d):
    m = table(s, d, ENT).select(F.explode(C.tokens(F.col("unique_interventions_linkbert_predictions"))).alias("x")).select(F.lower(F.trim("x")).alias("t")).where("t not in ('', 'none', 'none.')")
    k = table(s, d, "umls_concepts").select(F.lower(F.trim("str")).alias("t"), F.lit(1).alias("hit")).distinct()
    return m.join(k, "t", "left").agg(F.count("*").alias("processed"), F.count("hit").alias("matched")).withColumn("percent", F.round(100.0 * F.col("matched") / F.col("processed"), 4))


@query("e08_bootstrap")
def _(s, d):
    """Accuracy with its interval from 1,000 resamples."""
    return E.bootstrap(_pred(s, d).select((F.col("annotation_row_id") * 1_000_003 + F.col("doc_id")).alias("i"), (F.col("t") == F.col("s")).cast("int").alias("ok")), "i", "ok", 1000)


FEATURES = ["articles", "species", "countries", "strains", "assays", "rigorous"]


def _features(s, d):
    """Pairs with their target (any clinical evidence), the flag of both sexes, and the other features scaled to mean 0 and deviation 1."""
    up = table(s, d, TR).groupBy(F.col("normalized_key").alias("pair")).agg(F.max((F.col("clinical_count") > 0).cast("double")).alias("target"))
    f = heterogeneity(s, d).join(up, "pair").select("pair", F.coalesce("target", F.lit(0.0)).alias("target"), F.col("both_sexes").cast("double").alias("both_sexes"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    stats = F.broadcast(f.agg(*[x for c in FEATURES for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]))  # one row
    return f.crossJoin(stats).select("pair", "target", "both_sexes", *[F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)).alias(c) for c in FEATURES])


@query("m06_logistic_regression")
def _(s, d):
    """Odds ratios with Wald intervals and p-values, of all features together and of each alone."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data, every = _features(s, d).cache(), [*FEATURES, "both_sexes"]
    rows = []
    for kind, names in [("together", every), *[("alone", [c]) for c in every]]:
        x = VectorAssembler(inputCols=names, outputCol="x").transform(data)
        m = GeneralizedLinearRegression(family="binomial", featuresCol="x", labelCol="target", maxIter=50).fit(x)
        errors, p = m.summary.coefficientStandardErrors, m.summary.pValues
        rows += [(kind, n, float(b), float(e), math.exp(b), math.exp(b - 1.959964 * e), math.exp(min(700, b + 1.959964 * e)), float(q)) for n, b, e, q in zip(names, m.coefficients.toArray(), errors, p)]
    data.unpersist()
    return s.createDataFrame(rows, "model string, feature string, coefficient double, error double, odds_ratio double, low double, high double, p double")


@query("m07_cross_validation")
def _(s, d):
    """Ten folds by the hash of the pair: area under the curve, sensitivity and specificity of a logistic model on each fold left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[*FEATURES, "both_sexes"], outputCol="x").transform(_features(s, d)).withColumn("fold", F.pmod(F.xxhash64("pair"), F.lit(10))).select("x", "target", "fold").cache()
    rows = []
    for k in range(10):
        said = LogisticRegression(featuresCol="x", labelCol="target", maxIter=25, regParam=1e-3).fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))
        n = said.agg(F.count("*").alias("n"), *[F.count_if((F.col("target") == t) & (F.col("prediction") == p)).alias(c) for t, p, c in ((1, 1, "tp"), (1, 0, "fn"), (0, 1, "fp"), (0, 0, "tn"))]).first()
        auc = BinaryClassificationEvaluator(labelCol="target").evaluate(said) if n["n"] else None
        rows.append((k, n["n"], auc, n["tp"] / max(1, n["tp"] + n["fn"]), n["tn"] / max(1, n["tn"] + n["fp"])))
    data.unpersist()
    return s.createDataFrame(rows, "fold int, n bigint, auc double, sensitivity double, specificity double")


@query("m07_random_forest")
def _(s, d):
    """A forest on four fifths of the pairs, said of the rest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[*FEATURES, "both_sexes"], outputCol="x").transform(_features(s, d)).withColumn("fold", F.pmod(F.xxhash64("pair"), F.lit(5)))
    m = RandomForestClassifier(featuresCol="x", labelCol="target", numTrees=20, seed=7).fit(data.where("fold < 4"))
    return m.transform(data.where("fold = 4")).groupBy("target", "prediction").agg(F.count("*").alias("n"))

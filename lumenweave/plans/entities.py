"""Queries over entities in texts and cells, and what surrounds models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenweave.functions import cells as C
from lumenweave.operators import entities as N
from lumenweave.operators import models as M
from lumenweave.plans.registry import Registry
from lumenweave.plans.training import ANNOTATIONS as ANN
from lumenweave.plans.training import ENTITIES as ENT
from lumenweave.plans.training import METADATA as META
from lumenweave.session import fresh_path, table
from lumenweave.sources import files as S

TR, NER = "translation_table_drug_disease_full", "drug_disease_ner"
query = Registry()


@query("f09_clean_drugs", rf"""with t as (select entity_row_id, merged_umls_label cell, [trim(trim(trim(trim(x), '"'), '''')) for x in string_split(merged_umls_label, '|')] l from {ENT} where merged_umls_label is not null),
k as (select entity_row_id, cell, list_sort(list_distinct([case when lower(x) in ('vitamin d', 'vitamin d3', 'calcitriol', 'cholecalciferol') then 'vitamin D3' else x end for x in l if length(x) > 1 and not regexp_full_match(x, '[()\[\]{{}}''",.#\s\-_+=]+') and not regexp_full_match(x, '[#\s''"()+\-]*\d+[''")\s,]*')
    and not regexp_matches(lower(x), 'antibody|channel|receptor|modulator|blocker|agonist|antagonis|anti-|inhibitor') and regexp_full_match(x, '[A-Za-z0-9\-\s()]+')])) n from t)
select entity_row_id, case when len(n) = 0 then cell else array_to_string(n, '|') end as drugs from k""")
def _(s, d):
    return table(s, d, ENT).where("merged_umls_label is not null").select("entity_row_id", N.clean_drugs(F.col("merged_umls_label")).alias("drugs"))


@query("f16_display_label", f"select annotation_row_id, upper(left(j, 1)) || substr(j, 2) as label from (select annotation_row_id, regexp_replace(lower(trim(assay_type)), '(, .*)$', '') j from {ANN} where trim(assay_type) <> '')")
def _(s, d):
    """The first of the assay types as a heading."""
    first = F.regexp_replace(F.lower(F.trim("assay_type")), r"(, .*)$", "")
    return table(s, d, ANN).where("trim(assay_type) <> ''").select("annotation_row_id", F.concat(F.upper(F.left(first, F.lit(1))), F.substring(first, 2, 1_000_000)).alias("label"))


_PLACE = f"(select annotation_row_id, 'Department ' || annotation_row_id % 7 || case when annotation_row_id % 3 = 0 then '' else ', University, ' || case annotation_row_id % 5 when 0 then 'Wales' when 1 then 'Deutschland' when 2 then 'U.S.A.' when 3 then 'Nowhere' else 'The Netherlands' end end aff from {ANN})"


def _places(s, d):
    i = F.col("annotation_row_id")
    end = F.when(i % 5 == 0, "Wales").when(i % 5 == 1, "Deutschland").when(i % 5 == 2, "U.S.A.").when(i % 5 == 3, "Nowhere").otherwise("The Netherlands")
    return table(s, d, ANN).select(i, F.concat(F.lit("Department "), (i % 7).cast("string"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(", University, "), end))).alias("aff"))


_COUNTRY = r"case when regexp_matches(aff, 'Wales$') then 'United Kingdom' when regexp_matches(aff, 'Deutschland$') then 'Germany' when regexp_matches(aff, 'U\.S\.A\.$') then 'United States' when regexp_matches(aff, 'Netherlands$') then 'Netherlands' end"


@query("f19_country_keyword", f"select annotation_row_id, {_COUNTRY} as country from {_PLACE}")
def _(s, d):
    """Countries of affiliations, which are made up of the row ids, as the table's own countries have no other names."""
    return _places(s, d).select("annotation_row_id", N.country_of(F.col("aff")).alias("country"))


@query("f20_skipped_affiliations", f"select annotation_row_id, {_COUNTRY} is null and not contains(aff, ',') as skipped from {_PLACE}")
def _(s, d):
    return _places(s, d).select("annotation_row_id", N.skip_affiliation(F.col("aff"), N.country_of(F.col("aff"))).alias("skipped"))


@query("f42_safe_proportion", f"select pair_row_id, coalesce(round(clinical_count::double / nullif(clinical_count + preclinical_count, 0), 6), 0) as share from {TR} where clinical_count is not null and preclinical_count is not null")
def _(s, d):
    t = table(s, d, TR).where("clinical_count is not null and preclinical_count is not null")
    return t.select("pair_row_id", F.coalesce(F.round(F.try_divide(F.col("clinical_count"), F.col("clinical_count") + F.col("preclinical_count")), 6), F.lit(0.0)).alias("share"))


@query("f53_list_literals", f"select pair_row_id, len(list_distinct(pub_year)) as years, len(preclinical_doc_ids) as docs, preclinical_doc_ids[1] as first_doc from {TR} where pub_year is not null and preclinical_doc_ids is not null")
def _(s, d):
    """Lists written out as text, as a CSV file has them, and read again."""
    t = table(s, d, TR).where("pub_year is not null and preclinical_doc_ids is not null")
    quoted = F.concat(F.lit("["), F.array_join(F.transform("preclinical_doc_ids", lambda x: F.concat(F.lit("'"), F.replace(F.coalesce(x, F.lit("")), F.lit("'"), F.lit("")), F.lit("'"))), ", "), F.lit("]"))
    plain = F.concat(F.lit("["), F.array_join(F.col("pub_year").cast("array<string>"), ", ", "nan"), F.lit("]"))
    back = t.select("pair_row_id", C.literal_list(plain).alias("y"), C.literal_list(quoted).alias("docs"))
    years = F.array_distinct(F.filter("y", lambda x: x.isNotNull()))
    return back.select("pair_row_id", F.size(years).cast("bigint").alias("years"), F.size("docs").cast("bigint").alias("docs"), F.get("docs", F.lit(0)).alias("first_doc"))


_NAMED = rf"(select rec_id, doc_id, i, tokens[i] tok, split_part(upper(trim(string_split(ner_tags[i], '|')[1])), '-', 2) kind from (select * from {NER} where tokens is not null and ner_tags is not null), unnest(range(1, least(len(tokens), len(ner_tags)) + 1)) r(i))"


@query("f59_sets_by_type", f"select rec_id, coalesce(array_to_string(list_sort(list_distinct(list(e) filter (where kind = 'DISEASE'))), '|'), '') as diseases, coalesce(array_to_string(list_sort(list_distinct(list(e) filter (where kind = 'DRUG'))), '|'), '') as drugs from (select rec_id, kind, case when upper(tok) = 'TYPE' then 'kind' else lower(tok) end e from {_NAMED} where kind in ('DISEASE', 'DRUG') and length(tok) > 1 and tok not like '##%') group by 1")
def _(s, d):
    """Words of diseases and drugs of each record that has any; TYPE stands as an abbreviation."""
    n = F.least(F.size("tokens"), F.size("ner_tags"))
    kind = F.transform("ner_tags", lambda x: F.split_part(F.upper(F.trim(F.split(x, r"\|")[0])), F.lit("-"), F.lit(2)))
    t = table(s, d, NER).where("tokens is not null and ner_tags is not null").select("rec_id", F.slice(F.arrays_zip(kind.alias("kind"), F.col("tokens").alias("entity")), F.lit(1), n).alias("a"))
    short = F.create_map(F.lit("TYPE"), F.lit("kind"))
    sets = t.select("rec_id", N.by_type(F.col("a"), "DISEASE", short).alias("diseases"), N.by_type(F.col("a"), "DRUG", short).alias("drugs"))
    return sets.where("diseases <> '' or drugs <> ''")


@query("f62_title_or_abstract", r"with t as (select doc_id, text, strpos(text, ' | ') - 1 n, regexp_extract_all(text, '\b[a-z]+phorone\b') w from documents where strpos(text, ' | ') > 1), u as (select doc_id, text[1:n] title, list_distinct(w) w, w all_w from t where len(w) > 0) select doc_id, len([x for x in w if regexp_matches(title, '\b' || x || '\b')]) as in_title, len([x for x in w if len([y for y in all_w if y = x]) > len(regexp_extract_all(title, '\b' || x || '\b'))]) as in_abstract from u")
def _(s, d):
    """Names of a group of drugs with their places, told apart by the title before `` | ``."""
    p = r"\b[a-z]+phorone\b"
    t = table(s, d, "documents").where("locate(' | ', text) > 1 and text rlike '\\\\b[a-z]+phorone\\\\b'").select("doc_id", "text", F.substring_index("text", " | ", 1).alias("title"))
    pieces = F.split(F.regexp_replace("text", f"({p})", "\u0001$1\u0002"), "\u0001")
    spans = C.let(pieces, lambda ps: F.filter(F.transform(ps, lambda x, i: F.when(i > 0, F.struct(
        F.length(F.translate(F.array_join(F.slice(ps, F.lit(1), i), ""), "\u0002", "")).alias("start"),
        (F.length(F.translate(F.array_join(F.slice(ps, F.lit(1), i), ""), "\u0002", "")) + F.length(F.substring_index(x, "\u0002", 1))).alias("stop"),
        F.lit("DRUG").alias("kind"), F.substring_index(x, "\u0002", 1).alias("text")))), lambda x: x.isNotNull()))
    placed = t.select("doc_id", "title", spans.alias("spans"))
    count = lambda inside: F.size(N.in_title(F.col("title"), F.col("spans"), "DRUG", inside)).cast("bigint")
    return placed.select("doc_id", count(True).alias("in_title"), count(False).alias("in_abstract"))


#: Groups of diseases by a part of their name, in order; the first group wins.
GROUPS = [("movement", "dynosis"), ("movement", "ataxia"), ("attack", "plexy"), ("nerve", "pathia"), ("feeling", "asthesia"), ("wasting", "atrophy"), ("weakness", "paresis"), ("late", "late stage")]
_GROUPS = "(values " + ", ".join(f"({i}, '{g}', '{k}')" for i, (g, k) in enumerate(GROUPS)) + ") g(rank, grp, kw)"


@query("j15_keyword_groups", f"with t as (select pair_row_id, trim(string_split(lower(normalized_key), '<>')[1]) x from {TR} where normalized_key is not null), h as (select pair_row_id, min(rank) rank from t join {_GROUPS} on contains(x, kw) group by 1) select pair_row_id, grp as grp from h join {_GROUPS} using (rank)")
def _(s, d):
    terms = s.createDataFrame([(i, k) for i, (_, k) in enumerate(GROUPS)], "rank int, term string")
    t = table(s, d, TR).where("normalized_key is not null").select("pair_row_id", F.trim(F.split("normalized_key", "<>")[0]).alias("x"))
    names = F.create_map(*[F.lit(x) for i, (g, _) in enumerate(GROUPS) for x in (i, g)])
    return N.first_contained(t, "x", terms).where("rank is not null").select("pair_row_id", names[F.col("rank").cast("int")].alias("grp"))


@query("j16_longest_term", f"with k as (select distinct lower(name) k from ontology_terms where length(name) > 4), t as (select pair_row_id, lower(normalized_key) x from {TR} where normalized_key is not null), h as (select pair_row_id, min({{'l': -length(k), 'k': k}}) m from t join k on contains(x, k) group by 1) select pair_row_id, m.k as term from h")
def _(s, d):
    """The longest known disease in each key: an automaton over all names reads each key once."""
    names = N.longest_first(table(s, d, "ontology_terms").select(F.col("name").alias("term")), 4)
    return N.first_contained(table(s, d, TR).where("normalized_key is not null"), "normalized_key", names).where("term is not null").select("pair_row_id", "term")


_SETS = f"(select list_distinct([lower(trim(x)) for x in string_split(coalesce(drug_umls_term_norm, ''), '|') if length(trim(x)) > 2]) t, list_distinct([lower(trim(x)) for x in string_split(coalesce(unique_interventions_linkbert_predictions, ''), '|') if length(trim(x)) > 2]) s from {ENT})"


def _scores(s, d):
    return N.entity_scores(table(s, d, ENT), "drug_umls_term_norm", "unique_interventions_linkbert_predictions")


@query("e01_exact_scores", f"with x as (select sum(len(list_intersect(t, s))) tp, sum(len(s) - len(list_intersect(t, s))) fp, sum(len(t) - len(list_intersect(t, s))) fn from {_SETS}) select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp::double / (tp + fp), 6) as precision, round(tp::double / (tp + fn), 6) as recall, round(2.0::double * tp / (2 * tp + fp + fn), 6) as f1 from x")
def _(s, d):
    return _scores(s, d).where("match = 'exact'").drop("match")


@query("e01_partial_scores")
def _(s, d):
    return _scores(s, d).where("match = 'partial'").drop("match")


LABELS = ["blind", "random", "neither"]


def _logits(texts: list[str]) -> np.ndarray:
    return np.array([[2.0 * ("blind" in t.lower()), 1.0 * ("random" in t.lower()), 0.5] for t in texts])


@query("m01_text_labels", "select doc_id, case when b then 'blind' when r then 'random' else 'neither' end as label, round(greatest(exp(2.0 * b::int), exp(1.0 * r::int), exp(0.5)) / (exp(2.0 * b::int) + exp(1.0 * r::int) + exp(0.5)), 6) as confidence from (select doc_id, contains(lower(text), 'blind') b, contains(lower(text), 'random') r from documents where text is not null)")
def _(s, d):
    """A stand-in of three weighted words for the model; the envelope is what is run."""
    rows = table(s, d, "documents").where("text is not null")
    return M.classify_texts(rows, "doc_id", "text", _logits, LABELS).select(F.col("row_id").alias("doc_id"), "label", F.round("confidence", 6).alias("confidence"))


def _tag(words: list[str]) -> list[str]:
    return ["DRUG" if w.endswith("phorone") else "O" for w in words]


@query("m02_tagged_words", r"select doc_id, word, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '(?:^|[ \t\n\r\f\x0b])([^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*phorone)(?:[\s]|$)', 1)) word from (select doc_id, regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '  ', 'g') text from documents where text is not null)) group by 1, 2")
def _(s, d):
    """Words that a stand-in for the model tags, of all chunks of each text."""
    return M.tag_words(table(s, d, "documents"), "doc_id", "text", _tag).groupBy(F.col("row_id").alias("doc_id"), "word").agg(F.count("*").alias("n"))


def _answer(text: str, attempt: int) -> str | None:
    return text[: 10 * attempt]


def _valid(text: str, got: str) -> bool:
    return "a" in got


@query("m03_validated_answers", "select doc_id, case when contains(text[1:10], 'a') then text[1:10] when contains(text[1:20], 'a') then text[1:20] else text[1:30] end as answer, contains(text[1:30], 'a') as valid, case when contains(text[1:10], 'a') then 1 when contains(text[1:20], 'a') then 2 else 3 end::int as attempts from documents where text <> ''")
def _(s, d):
    """Answers of a stand-in that gives ten characters more each time, until one holds an ``a``."""
    rows = table(s, d, "documents").where("text <> ''")
    return M.generate(rows, "doc_id", "text", _answer, _valid).withColumnRenamed("row_id", "doc_id")


@query("m04_constrained_lists", f"select entity_row_id, array_to_string(case when len(a) > 0 and len([x for x in a if not list_contains(o, x)]) = 0 then a else o end, '|') as kept from (select entity_row_id, string_split(drug_umls_term_norm, '|') a, string_split(unique_interventions_linkbert_predictions, '|') o from {ENT} where unique_interventions_linkbert_predictions is not null and drug_umls_term_norm is not null)")
def _(s, d):
    t = table(s, d, ENT).where("unique_interventions_linkbert_predictions is not null and drug_umls_term_norm is not null")
    return t.select("entity_row_id", F.array_join(M.constrained(F.split("drug_umls_term_norm", r"\|"), F.split("unique_interventions_linkbert_predictions", r"\|")), "|").alias("kept"))


@query("m05_text_classifier")
def _(s, d):
    """Language labels by words, fitted on at most 2,000 labelled texts, said of all: how often label and prediction meet."""
    rows = table(s, d, "documents").where("text is not null").select("doc_id", "text", F.lower(F.substring("lang", 1, 2)).alias("lang"))
    named = rows.where(F.col("lang").isin("de", "en", "es", "fr", "it", "pt"))
    train = named.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(2000)
    return M.text_labels(train, named, "text", "lang").groupBy("lang", "predicted").agg(F.count("*").alias("n"))


@query("f64_answer_json", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(s, d):
    """Objects in answers: in tags, in a fence, or the last one said."""
    i = F.col("event_id") % 3
    told = F.when(i == 0, F.concat(F.lit("It is <json>"), "props", F.lit("</json> {x}"))).when(i == 1, F.concat(F.lit("So:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit('{"k": 0} or rather '), "props", F.lit(".")))
    return table(s, d, "events").select("event_id", F.get_json_object(M.json_of(told), "$.k").alias("k"))


@query("s07_chunk_files", "select c_custkey, c_custkey % 4 + 1 as chunk from customer")
def _(s, d):
    """Files with a number in their name, which comes with their rows."""
    root, t = fresh_path(s, "chunks"), table(s, d, "customer").select("c_custkey")
    fs = s._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(s._jsc.hadoopConfiguration())
    for k in range(4):
        t.where(F.col("c_custkey") % 4 == k).coalesce(1).write.csv(f"{root}/tmp{k}", header=True)
        made = [x.getPath() for x in fs.listStatus(s._jvm.org.apache.hadoop.fs.Path(f"{root}/tmp{k}")) if x.getPath().getName().startswith("part-")]
        fs.mkdirs(s._jvm.org.apache.hadoop.fs.Path(f"{root}/all"))
        fs.rename(made[0], s._jvm.org.apache.hadoop.fs.Path(f"{root}/all/rows_{k + 1}.csv"))
    return S.read_chunks(s, f"{root}/all", "c_custkey bigint").withColumn("chunk", F.col("chunk").cast("bigint"))


@query("s15_remote_fetch", "select distinct o_orderpriority as key, upper(o_orderpriority) as content from orders where o_orderpriority not like '1%'")
def _(s, d):
    """Contents by a function of the caller's; keys that are done are left out."""
    keys = table(s, d, "orders").select(F.col("o_orderpriority").alias("key"))
    return S.fetch(keys, "key", str.upper, keys.where("key like '1%'"), wait=0.0).select("key", "content")


@query("s17_json_lines_sink", "select doc_id, text from documents where text is not null")
def _(s, d):
    S.write_jsonl(table(s, d, "documents").where("text is not null").select("doc_id", "text"), p := fresh_path(s, "json"))
    return s.read.schema("doc_id bigint, text string").json(p)


@query("s05_target_records", f"select pmid, title from {META} where pmid in (select pmid from {ENT}) and title is not null and not regexp_matches(pmid || title, '[|\n\r]')")
def _(s, d):
    """Records of the wanted articles only."""
    m = table(s, d, META).where("title is not null and not (concat(pmid, title) rlike '[|\n\r]')")
    m.select(F.concat_ws("|||", "pmid", "title")).write.text(p := fresh_path(s, "text"))
    return S.read_records(s, p, ["pmid", "title"], only=table(s, d, ENT).select("pmid")).drop("chunk")

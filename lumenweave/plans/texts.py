"""Queries over text: classifiers, document rules, ages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import ages as A
from lumenweave.functions import biology as B
from lumenweave.functions.text import article, without_accents
from lumenweave.operators import classify as K
from lumenweave.plans.registry import Registry
from lumenweave.plans.training import ANNOTATIONS as ANN
from lumenweave.plans.training import ENTITIES as ENT
from lumenweave.plans.training import METADATA as META
from lumenweave.session import table

NER = "drug_disease_ner"
query = Registry()


# The SQL has its patterns written out, not those of the library; a word is letters, digits and underscores in both.
_SENT = r"""(with cut as (select doc_id, string_split(regexp_replace(regexp_replace(translate(text, chr(1), ' '), '([.!?])[ \t\n\r\f]+', '\1 ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) s from documents where text is not null),
pieces as (select doc_id, i, s[i] p, case when i > 1 then s[i - 1] end b from cut, unnest(range(1, len(s) + 1)) r(i)),
marked as (select *, case when i > 1 and (regexp_matches(b, '(^|[^\p{L}\p{N}_.])(i\.c\.v|i\.p|i\.v|i\.m|s\.c|i\.t|p\.o|[Ff]igs?|[Tt]able|[Rr]ef|[Ii]nc|inh|c|p|g|[Nn]o|vs|spp?|al)\.$') or regexp_matches(b, '(^|[^\p{L}\p{N}_])([A-Z]\.){1,6}$')
    or regexp_matches(p, '^([\p{Ll}(),]|\d( |$)|Mb?([^\p{L}\p{N}_]|$)|[\p{L}\p{N}_]+,?\d{4}[a-z]?( |$))')) then 0 else 1 end brk from pieces),
grouped as (select *, sum(brk) over (partition by doc_id order by i) - 1 g from marked),
joined as (select doc_id, g sentence_id, string_agg(p, ' ' order by i) sentence from grouped group by 1, 2),
counted as (select *, regexp_extract_all(sentence, '[\p{L}\p{N}_]+(?:[-.,''’/][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]') t from joined)
select doc_id, sentence_id, sentence from counted where len(t) > 3 and not regexp_full_match(sentence, '[\d\s()]+\.*') and not regexp_matches(sentence, '^\[\s*\d+\s*\]') and len([x for x in t[1:4] if regexp_full_match(x, '\d+')]) < 4)"""


def _around(left: str, hit: str, right: str) -> str:
    """SQL of a hit with up to twelve words on either side."""
    return rf"regexp_extract({left}, '((?:[\p{{L}}\p{{N}}_]+[^\p{{L}}\p{{N}}_]+){{0,12}})$', 1) || {hit} || regexp_extract({right}, '^((?:[^\p{{L}}\p{{N}}_]*[\p{{L}}\p{{N}}_]+){{0,12}})', 1)"


def _clear(p: str) -> str:
    """SQL: the first hit of a pattern has neither ``patient`` nor ``females versus males`` around it."""
    window = _around(rf"regexp_extract(sentence, '(?is)^(.*?)(?:{p})', 1)", f"regexp_extract(sentence, '(?i){p}')", rf"regexp_extract(sentence, '(?is)^.*?(?:{p})(.*)$', 1)")
    return rf"(regexp_matches(sentence, '(?i){p}') and not regexp_matches({window}, '(?i)\b(patients?|females?\s+versus\s+males?)\b'))"


def _one_of(*patterns: str) -> str:
    return "(" + " or ".join(map(_clear, patterns)) + ")"


_SEX = f"select doc_id, sentence_id, {_one_of(r'\bfemales?\b', r'\bmaternal\b', r'\bmothers?\b', r'\bsisters?\b', r'\bpregnant?\b')} f, {_one_of(r'\bmales?\b', r'\bfathers?\b', r'\bbrothers?\b')} m, {_one_of(r'\beither sex(?:es)?\b', r'\bboth sex(?:es)?\b', r'\b(?:of|the)\s+either sex(?:es)?\b')} b from {_SENT}"
_HIT = r"(?i)\b(guinea[-\s]?pigs?|mouse|mice|rats?|rabbits?|monkeys?|chimpanzees?|orangutans?|bonobos?|gibbons?|gorillas?|macaques?|rhesus|cynomolgus|baboons?|papio|vervets?|grivets?|african green monkeys?|marmosets?|tamarins?|squirrel monkeys?|saimiri|capuchins?|non-?human primates?|nhp|dogs?|cats?|pigs?|swines?|piglets?)\b"
_NO_ANIMAL = (
    r"(?i)\b(antibody|antibodies|antiserum|antisera|antigens?|tissues?|dilution|monoclonal|polyclonal|wako|peptides?|Ig\s*[A-Z]{1,2}|Ig-?coated|mAb|pAb|HRP|APC|FITC|PE|MBP|Cy\d+|myelin\s+basic\s+protein|ELISA|immunoblot|western\s+blot|immunostaining"
    r"|conjugated|biotinylated|fluorescent-?labeled|GAPDH|tubulin|emulsified|emulsion|injections?\s+of|activated\s+by|primary\s+cultures?|luciferase|peroxidase|polymerase|qPCR|RT-PCR|Taq|serum|lysate|recombinant|TG2|anti|OX\d+|CD\d+)\b"
    r"|\b(rabbit|mouse|goat|rat|sheep|hamster|donkey|chicken|guinea\s*pig|llama|alpaca|human)\s*([–-]\s*)?(α|anti[-\s]?)\s*[^\),;]{2,80}"
    r"|\b[A-Z]{2,}\.?[\s,;:]+\d{1,4}(\s*\(\s*\d{1,4}\s*\))?[\s,;:]+(19\d{2}|20\d{2}|21\d{2})[\s,;:]+\d{1,6}|\b[A-Z]{2,}\.?\s+(19\d{2}|20\d{2}|21\d{2})\s*;\s*\d{1,4}\s*:\s*\d{1,6}|\b(obtained|purified|isolated|harvested|derived)\s+from\b"
)
# The tables have neither cats nor feeds or diets named after an animal, so what the library looks for around these is left out.
_SPECIES = rf"""(with cut as (select doc_id, sentence_id, sentence, string_split(regexp_replace(sentence, '{_HIT}', chr(1) || '\1' || chr(2), 'g'), chr(1)) p from {_SENT}),
parts as (select doc_id, sentence_id, sentence, [{{'l': replace(array_to_string(p[1:i - 1], ''), chr(2), ''), 'h': lower(string_split(p[i], chr(2))[1]), 'r': string_split(p[i], chr(2))[2] || replace(array_to_string(p[i + 1:], ''), chr(2), '')}} for i in range(2, len(p) + 1)] x from cut),
good as (select doc_id, sentence_id, sentence, [case when y.h in ('mouse', 'mice') then 'mouse' when y.h in ('rat', 'rats') then 'rat' when y.h in ('rabbit', 'rabbits') then 'rabbit' when y.h like 'guinea%' then 'guinea pig'
    when y.h in ('dog', 'dogs') then 'dog' when y.h in ('cat', 'cats') then 'cat' when y.h in ('pig', 'pigs', 'swine', 'swines', 'piglet', 'piglets') then 'pig' else 'monkey' end for y in x
    if not regexp_matches(y.l, '(?i)(not\s+(a|an|the)\s+|no\s+)$') and not regexp_matches({_around('y.l', 'y.h', 'y.r')}, '{_NO_ANIMAL}')] g from parts)
select doc_id, sentence_id, sentence, case when len(g) = 0 then ['species-other'] else [y for y in ['mouse', 'rat', 'rabbit', 'monkey', 'guinea pig', 'dog', 'cat', 'pig'] if list_contains(g, y)] end labels from good)"""


@query("c01_sample_size", r"""select doc_id, case when coalesce(regexp_matches(text, '(?i)\bno\s+(?:a\s+priori\s+)?(?:sample[-\s]?size\s+(?:calculation|estimation|determination)|power\s+analysis)\b|\b(?:sample[-\s]?size|power\s+analysis)\s+(?:was|were)\s+not\s+(?:performed|conducted|done|carried\s+out|calculated|estimated|determined)\b|\bno\s+sample[-\s]?size\s+(?:was|were)\s+(?:calculated|estimated|determined|computed)\b|\b(?:without|lacking)\s+(?:a\s+priori\s+)?(?:sample[-\s]?size\s+(?:calculation|estimation|determination)|power\s+analysis)\b|\bno\s+power\s+calculation\b'), false) then 2
when coalesce(regexp_matches(text, '(?i)\bsample[-\s]?sizes?\s+(?:was|were)\s+(?:calculated|estimated|determined|computed|predetermined)\b|\b(?:we|authors?)\s+(?:calculated|estimated|determined)\s+the\s+sample[-\s]?size\b|\bsample[-\s]?size\s+(?:calculation|estimation|determination)\s+(?:was|were)\s+(?:performed|conducted|done|carried\s+out)\b|\bpower\s+(?:analysis|calculation)\b|\b(?:samples?\s+sizes?|number\s+of\s+(?:mice|rats|animals|subjects)(?:\s+per\s+group)?)\s+was\s+(?:determined|set|chosen)\s+(?:by|based\s+on|according\s+to)\b|\bpower\s*(?:=|of)\s*\d+(?:\.\d+)?\s*(?:%|percent)?\b.*?\b(?:alpha|α)\s*(?:=|of)?\s*0?\.\d+\b|\b(?:alpha|α)\s*(?:=|of)?\s*0?\.\d+\b.*?\bpower\s*(?:=|of)\s*\d|\bensure\s+adequate\s+power\b|\bsufficient\s+to\s+attain\s+statistical\s+power\b'), false) then 1 else 0 end::int as code from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", K.sample_size(F.col("text")).alias("code"))


def _rows(s, d):
    return K.sentences(table(s, d, "documents"), "doc_id", "text")


@query("c02_sex", f"select doc_id, sentence_id::int as sentence_id, case when b or (f and m) then 'sex-both' when f then 'sex-female' when m then 'sex-male' else 'sex-not-reported' end as sex from ({_SEX})")
def _(s, d):
    return _rows(s, d).select("doc_id", "sentence_id", K.sex(F.col("sentence")).alias("sex"))


@query("c03_species", f"select doc_id, sentence_id::int as sentence_id, array_to_string(labels, ',') as species from {_SPECIES}")
def _(s, d):
    return _rows(s, d).select("doc_id", "sentence_id", F.array_join(K.species(F.col("sentence")), ",").alias("species"))


@query("c04_welfare", rf"""select doc_id, sentence_id::int as sentence_id, (regexp_matches(sentence, '(?i)\b(approved|approval|authorized|reviewed|(carried out|conducted|performed) (in|under)? (strict )?(accordance|compliance|adherence)? (with|to)|in (strict )?(accordance|compliance|adherence)? (with|to)|according to( the)? (institutional |national |international |ethical )?(guidelines|policy|regulations|standards|rules|principles)|conformed (to|with)|complied (with|to)?( relevant)? (guidelines|regulations|standards)?|treated according to( the)? (guidelines|regulations|standards)?|in (compliance|accord|agreement|adherence) (with|to)|(Institutional|Animal|Ethics) Committee|IACUC|CPCSEA|Guide for the Care and Use of Laboratory Animals|Directive (86/609|2010/63)[/\w]*|ARRIVE guidelines|Animal Care|ethical treatment|Declaration of Helsinki|ethical (standards|guidelines|policies)|international (laws|standards|guidelines)|regulations (of|from|by) .*animal.*)\b')
and not regexp_matches(sentence, '(?i)\b(humans?|authors?|subjects?|patients?|volunteers?|donors?|method described by|manufacturer(''s)?|company|euthanized|inc|ltd|sigma|fisher|thermo|roche|abbott|bio-rad)\b'))::int as code from {_SENT}""")
def _(s, d):
    return _rows(s, d).select("doc_id", "sentence_id", K.welfare(F.col("sentence")).alias("code"))


@query("c05_blinding", "select doc_id, coalesce(regexp_matches(lower(text), 'blinded|were blind|blind'), false)::int as code from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", K.blinding(F.col("text")).alias("code"))


@query("c06_randomization", r"select doc_id, coalesce(regexp_matches(text, '(?i)\b(randomized( control(led)? (trial|study))?|randomized (mice|rats|animals|groups)|(were|was|had been)?\s*randomly (assigned|divided|grouped|grouping|selected|allocated|placed|chosen|culled|distributed)|(assigned|divided|grouped|grouping|allocated|chosen|selected|culled) randomly|(assigned|divided|grouped|allocated|placed|selected|chosen) at random|pseudorandomly (assigned|placed|culled|selected)?|random (assignment|allocation)|randomization (was performed|of animals)?)\b'), false)::int as code from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", K.randomization(F.col("text")).alias("code"))


@query("c07_age_mention", r"select doc_id, coalesce(regexp_matches(text, '(?i)\b(age|ages|aged|aging|old|older|young|adults?|mature|senescent|neonatal|neonate|newborn|pups?|juvenile|weanling|weaning|postnatal|prenatal|prepubescent|fetal|fetus|fetuses|(day|week|month|year)[-\s]?old|\d+\s*[-–to]+\s*\d+\s*(day|week|wk|month|year|yr)s?|\d+\s*(day|week|wk|month|year|yr)s?|after\s+birth|post[-\s]?birth)\b'), false)::int as code from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", K.age_mention(F.col("text")).alias("code"))


DOMAINS = {"behavior": {"open field": "open field test", "maze": "maze", "forced test": "forced swim test", "grip strength": "grip test"}, "histology": {"stained": "staining", "light microscope": "microscopy", "sections examined": "section count"}}


VOCABULARY = [(domain, synonym, canonical) for domain, names in DOMAINS.items() for synonym, canonical in names.items()]
_WORDS = "(values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in VOCABULARY) + ") v(domain, synonym, canonical)"


def _found(rows: str, keys: str, text: str) -> str:
    """SQL of each hit of each domain: the longest synonym at a place."""
    return "(" + " union all ".join(f"select {keys}, '{domain}' as domain, unnest(regexp_extract_all(lower({text}), '\\b({'|'.join(sorted(names, key=lambda x: (-len(x), x)))})\\b', 1)) x from {rows}" for domain, names in DOMAINS.items()) + ")"


def _vocabulary(s):
    return K.vocabulary(s.createDataFrame(VOCABULARY, "domain string, synonym string, canonical string"))


@query("c08_assay_domains", f"select d.doc_id, g.domain, (count(v.canonical) > 0)::int as hit, coalesce(string_agg(distinct v.canonical, '|' order by v.canonical), '') as found from documents d cross join (select distinct domain from {_WORDS}) g left join {_found('documents', 'doc_id', 'text')} f on f.doc_id = d.doc_id and f.domain = g.domain left join {_WORDS} on v.domain = f.domain and v.synonym = f.x group by 1, 2")
def _(s, d):
    """Each document and each domain of the dictionary table: whether it is hit, and the canonical names."""
    hits = K.assay_domains(table(s, d, "documents"), ["doc_id"], "text", _vocabulary(s))
    return hits.select("doc_id", "domain", (F.size("names") > 0).cast("int").alias("hit"), F.array_join("names", "|").alias("found"))


@query("c09_number_contexts")
def _(s, d):
    """Where the numbers of animals that an article's annotation gives stand in its text, and whether an animal is near."""
    notes = table(s, d, ANN).select("annotation_row_id", article(F.col("pmid")).alias("k"), F.nullif("animal_number", F.lit("not reported")).alias("numbers")).where("k is not null and numbers is not null")
    texts = table(s, d, "documents").select("doc_id", article(F.col("pmid")).alias("k"), "text").where("k is not null and text is not null")
    return K.number_contexts(notes.join(texts, "k"), ["annotation_row_id", "doc_id"], "text", "numbers")


@query("c10_animal_sentences", rf"select doc_id, count(*) as n from {_SPECIES} where labels <> ['species-other'] or regexp_matches(sentence, '(?i)\banimals?\b') group by 1")
def _(s, d):
    return _rows(s, d).where(K.animal_context(F.col("sentence"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("c11_week_expression", r"select doc_id, regexp_matches(text, '(?i)\b(age|ages|aged|aging|old|older|young|adults?|senescent|neonatal|neonate|newborn|pups?|juvenile|weanling|weaning|postnatal|prenatal|prepubescent|fetal|fetus|fetuses|week[-\s]?old|\d+\s*(?:-|–|to)\s*\d+\s*(?:week|wk)s?|\d+\s*(?:week|wk)s?|after\s+birth|post[-\s]?birth)\b') as has_weeks from documents where text is not null")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", K.week_age(F.col("text")).alias("has_weeks"))


@query("c12_model_mentions")
def _(s, d):
    """Every mention of a disease model in titles and in documents."""
    titles = table(s, d, META).select(F.lit(META).alias("src_table"), F.col("meta_row_id").alias("row_id"), F.col("title").alias("text"))
    texts = table(s, d, "documents").select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("row_id"), "text")
    return K.model_mentions(titles.union(texts), ["src_table", "row_id"], "text")


@query("a09_zero_fallback", f"with c as (select doc_id, sentence_id, regexp_matches(lower(sentence), 'blind')::int code from {_SENT}), m as (select doc_id, max(code) code from c group by 1) select m.doc_id, m.code, string_agg(sentence_id::varchar, ',' order by sentence_id) as support from m join c on c.doc_id = m.doc_id and (m.code = 0 or c.code > 0) group by 1, 2")
def _(s, d):
    return K.zero_fallback(_rows(s, d).select("doc_id", "sentence_id", K.blinding(F.col("sentence")).alias("c")), "doc_id", "c", "sentence_id")


@query("a10_species_rule", f"""with l as (select doc_id, sentence_id, unnest(labels) l from {_SPECIES}), n as (select doc_id, l, count(distinct sentence_id) n, list_sort(list(distinct sentence_id)) ids from l group by 1, 2),
m as (select doc_id, coalesce(max(n) filter (where l <> 'species-other'), 0) most from n group by 1),
k as (select n.*, most from n join m using (doc_id) where case when most = 0 then true else l <> 'species-other' and n >= least(most, 2) end)
select doc_id, string_agg(l, ',' order by l) as species, string_agg(n::varchar, ',' order by l) as sentences, (select string_agg(i::varchar, ',' order by i) from (select distinct unnest(flatten(list(k.ids))) i)) as support from k group by 1""")
def _(s, d):
    rows = _rows(s, d).select("doc_id", "sentence_id", K.species(F.col("sentence")).alias("labels"))
    return K.species_rule(rows, "doc_id", "labels", "sentence_id")


@query("a11_assay_domains", f"with h as (select doc_id, sentence_id, f.domain, canonical from {_found(_SENT, 'doc_id, sentence_id', 'sentence')} f join {_WORDS} on v.domain = f.domain and v.synonym = f.x), g as (select doc_id, domain, string_agg(distinct canonical, ', ' order by canonical) as names, (select string_agg(i, ', ') from unnest(list_sort(list(distinct sentence_id))) u(i)) as ids from h group by 1, 2) select doc_id, string_agg(domain, ', ' order by domain) as labels, string_agg(domain || ': ' || names, '; ' order by domain) as names, string_agg(domain || ': ' || ids, '; ' order by domain) as sentences from g group by 1")
def _(s, d):
    """Of each document with a hit the domains, and for each domain its names and sentences."""
    rows = _rows(s, d)
    hits = K.assay_domains(rows, ["doc_id", "sentence_id"], "sentence", _vocabulary(s)).where(F.size("names") > 0)
    g = hits.groupBy("doc_id", "domain").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ", ").alias("names"), F.array_join(F.array_sort(F.collect_set("sentence_id")).cast("array<string>"), ", ").alias("ids"))
    each = F.sort_array(F.collect_list(F.struct("domain", F.concat_ws(": ", "domain", "names").alias("names"), F.concat_ws(": ", "domain", "ids").alias("ids"))))
    return g.groupBy("doc_id").agg(each.alias("e")).select("doc_id", F.array_join("e.domain", ", ").alias("labels"), F.array_join("e.names", "; ").alias("names"), F.array_join("e.ids", "; ").alias("sentences"))


@query("a32_paragraph_concat", f"select doc_id, string_agg(sentence, chr(10) order by sentence_id) as text from {_SENT} group by 1")
def _(s, d):
    rows = _rows(s, d)
    parts = F.sort_array(F.collect_list(F.struct("sentence_id", "sentence")))
    return rows.groupBy("doc_id").agg(F.array_join(parts["sentence"], "\n").alias("text"))


@query("f01_lower_squeeze", f"select meta_row_id, trim(regexp_replace(lower(journal_name), '\\s+', ' ', 'g')) as j from {META}")
def _(s, d):
    return table(s, d, META).select("meta_row_id", F.trim(F.regexp_replace(F.lower("journal_name"), r"\s+", " ")).alias("j"))


@query("f02_all_without_accents", "select doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') as plain from documents")
def _(s, d):
    """Every document, whatever its label of language."""
    return table(s, d, "documents").select("doc_id", F.regexp_replace(without_accents(F.lower("text")), "[^a-z]", "").alias("plain"))


@query("f03_repaired_spaces", f"select rec_id, regexp_replace(regexp_replace(regexp_replace(t, '\\s*([-/])\\s*', '\\1', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g') as text from (select rec_id, list_aggregate([x for x in tokens if x is not null], 'string_agg', ' ') t from {NER} where tokens is not null and len(tokens) > 0)")
def _(s, d):
    t = table(s, d, NER).where("tokens is not null and size(tokens) > 0")
    joined = F.concat_ws(" ", F.filter("tokens", lambda x: x.isNotNull()))
    return t.select("rec_id", B.repaired(joined).alias("text"))


@query("f04_title_case", rf"select entity_row_id, list_aggregate([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all(regexp_replace(unique_conditions_linkbert_predictions, '\s*##', '', 'g'), '\p{{L}}+|[^\p{{L}}]+')], 'string_agg', '') as cell from {ENT} where unique_conditions_linkbert_predictions <> ''")
def _(s, d):
    return table(s, d, ENT).where("unique_conditions_linkbert_predictions <> ''").select("entity_row_id", B.titled(F.col("unique_conditions_linkbert_predictions")).alias("cell"))


@query("f05_control_characters", "select doc_id, trim(translate(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), chr(8232) || chr(8233) || chr(8220) || chr(8221) || chr(8216) || chr(8217), '  \"\"' || chr(39) || chr(39)), ' \t\n') as text from documents where text is not null")
def _(s, d):
    t = F.translate(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f\x7f]", ""), "\u2028\u2029“”‘’", "  \"\"" + "'" * 2)
    return table(s, d, "documents").where("text is not null").select("doc_id", F.btrim(t, F.lit(" \t\n")).alias("text"))


@query("f07_singular", f"select term, case when length(term) > 3 and regexp_matches(term, '[^siu]s$') then term[:-2] else term end as one from (select distinct trim(unnest(string_split(unique_interventions_linkbert_predictions, '|'))) term from {ENT}) where term is not null")
def _(s, d):
    t = table(s, d, ENT).select(F.explode(F.split("unique_interventions_linkbert_predictions", r"\|")).alias("x")).select(F.trim("x").alias("term")).distinct()
    return t.select("term", B.singular(F.col("term")).alias("one"))


_STAGE = r"(?i)^(.+?),?(?:\s+type)?\s+(\d+[a-z]?|[ivx]+|[a-z]|[a-z]{1,2}\d{1,2}[a-z]?)$"


@query("f08_root_stage", f"select id, regexp_extract(n, '{_STAGE}', 1) as root, regexp_extract(n, '{_STAGE}', 2) as stage from (select id, regexp_replace(trim(n), '(?i)[\\s,]+(and|or)$', '') n from (select id, name n from ontology_terms union all select id || '-' || i, 'case ' || n_name || case i % 4 when 0 then ' IV' when 1 then ', type 2' when 2 then ' 1b and' else ' x' end from (select 'nation' id, n_nationkey i, n_name from nation))) where regexp_matches(n, '{_STAGE}') and lower(regexp_extract(n, '{_STAGE}', 1)) not in ('disease', 'syndrome', 'disorder', 'deficiency', 'type', 'form', 'group', 'stage', 'grade', 'class') and not contains(lower(n), 'chromosome')")
def _(s, d):
    """Roots and stages of the terms, and of names with other stages, made up of the nations."""
    i = F.col("n_nationkey") % 4
    more = table(s, d, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("case "), "n_name", F.when(i == 0, " IV").when(i == 1, ", type 2").when(i == 2, " 1b and").otherwise(" x")).alias("name"))
    return table(s, d, "ontology_terms").select("id", "name").union(more).select("id", B.root_and_stage(F.col("name")).alias("x")).where("x.root is not null").select("id", "x.root", "x.stage")


@query("f11_plus_minus", r"select doc_id, raw, printf('%.2f', greatest(0, m - e)) || ', ' || printf('%.2f', m + e) as range from (select doc_id, raw, regexp_extract(raw, '^([\d.]+)', 1)::double m, regexp_extract(raw, '([\d.]+)$', 1)::double e from (select doc_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)? ?± ?\d+(?:\.\d+)?)', 1)) raw from documents))")
def _(s, d):
    found = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)? ?± ?\d+(?:\.\d+)?)"), F.lit(1))).alias("raw"))
    return found.select("doc_id", "raw", B.plus_minus(F.col("raw")).alias("range"))


_WEEKS = "case u when 'day' then n // 7 when 'week' then n when 'month' then floor(n * 4.345) when 'year' then n * 52 end::int"
_EVERY_AGE = "(select doc_id, pos::int as pos, try_cast(ns[pos] as int) n, us[pos] u from (select doc_id, regexp_extract_all(text, '(\\d+) (day|week|month|year)s?\\b', 1) ns, regexp_extract_all(text, '(\\d+) (day|week|month|year)s?\\b', 2) us from documents where text is not null), unnest(range(1, len(ns) + 1)) r(pos))"


@query("f30_every_age", f"select doc_id, pos, w as weeks, case when w < 8 then 'young' when w < 60 then 'adult' when w >= 60 then 'aged' end as age_class from (select doc_id, pos, {_WEEKS} w from {_EVERY_AGE})")
def _(s, d):
    """One row for each age expression of a document; a number beyond 32 bits has neither weeks nor class."""
    p = F.lit(r"(\d+) (day|week|month|year)s?\b")
    both = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("n"), F.regexp_extract_all("text", p, F.lit(2)).alias("u"))
    t = table(s, d, "documents").select("doc_id", F.posexplode(both).alias("at", "x")).select("doc_id", (F.col("at") + 1).alias("pos"), F.col("x.n").try_cast("int").alias("n"), F.col("x.u").alias("u"))
    w = B.weeks(F.col("n"), F.col("u"))
    return t.select("doc_id", "pos", w.alias("weeks"), B.age_class(w).alias("age_class"))


_SAID = r"(select doc_id, text, list_aggregate(regexp_extract_all(text, '\d+(?:\s*(?:-|–|to|or|and)\s*\d+)? (?:days?|weeks?|months?|years?)'), 'string_agg', ', ') raw from documents where regexp_matches(text, '\d+(?:\s*(?:-|–|to|or|and)\s*\d+)? (?:days?|weeks?|months?|years?)'))"
_SAID_AGE = r"(\d+(?:\s*(?:-|–|to|or|and)\s*\d+)? (?:days?|weeks?|months?|years?))"


def _said(s, d):
    """Every age of each document, as one list."""
    ages = F.regexp_extract_all("text", F.lit(_SAID_AGE), F.lit(1))
    return table(s, d, "documents").select("doc_id", "text", F.array_join(ages, ", ").alias("raw")).where("raw <> ''")


@query("f10_normal_age", rf"select doc_id, regexp_replace(regexp_replace(regexp_replace(translate('<' || raw || ' old', '–—~<>', '---'), '\s*-\s*', '-', 'g'), '(years?|days?)[ -]old', '\1', 'g'), '(\d)[ -](?:weeks?)[ -]old', '\1 weeks', 'g') as age from (select doc_id, regexp_replace(raw, '(\d)[ -]?(year|day)\b', '\1 \2s', 'g') raw from {_SAID})")
def _(s, d):
    return _said(s, d).select("doc_id", A.normal_age(F.concat(F.lit("<"), "raw", F.lit(" old"))).alias("age"))


_CLEANED = rf"""(with u as (select doc_id, text, raw, lower(regexp_extract(raw, '(?i)\b(weeks?|months?|days?|years?)$', 1)) unit, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\s+(and|or)\s+', ' , ', 'g'), '(\d+) (weeks?|months?|days?|years?)\s+to\s+(\d+) (weeks?|months?|days?|years?)', '\1-\3 \2', 'g'), '(\d+)\s+to\s+(\d+)', '\1-\2', 'g'), '\s*[-–]\s*', '-', 'g') t from {_SAID}),
p as (select doc_id, text, raw, [case when regexp_full_match(trim(x), '\d+(-\d+)?') then trim(x) || ' ' || unit else trim(x) end for x in string_split(t, ',') if trim(x) <> ''] l from u),
n as (select doc_id, text, raw, [l[i] for i in range(1, len(l) + 1) if list_position(l, l[i]) = i] l from p) select doc_id, text, raw, array_to_string(l, ', ') age from n)"""


@query("f12_cleaned_ages", f"select doc_id, age from {_CLEANED}")
def _(s, d):
    return _said(s, d).select("doc_id", A.cleaned_ages(F.concat(F.lit("AGE: "), "raw", F.lit(" ### 20 g"))).alias("age"))


@query("f32_classified_ages", rf"""with p as (select doc_id, age, unnest(string_split(age, ', ')) x from {_CLEANED}),
q as (select doc_id, age, split_part(x, ' ', 1) n, split_part(x, ' ', 2) u from p),
d as (select doc_id, age, u, case when try_cast(n as double) > 150 and u = 'weeks' then case when length(n) = 3 then n[1] || '-' || n[2:] else n[1:2] || '-' || n[3:] end when try_cast(n as double) > 1000 and u = 'days' then n[1:2] || '-' || n[3:] else n end n from q),
e as (select doc_id, age, u, n, unnest([try_cast(y as double) for y in string_split(n, '-') if try_cast(y as double) is not null]) y from d),
w as (select doc_id, age, u, n, y, case when u = 'weeks' then y when u in ('days', 'day', 'd') then floor(y / 7) when u in ('months', 'month', 'mo') then floor(y * 4.345) when u in ('years', 'year') then y * 52 end w from e),
c as (select doc_id, string_agg(distinct c, ', ' order by c) c from (select doc_id, case when w < 8 then 'young' when w < 60 then 'adult' else 'aged' end c from w where w is not null) group by 1),
a as (select doc_id, string_agg(distinct a, ', ' order by a) a from (select doc_id, case when u = 'weeks' then n || ' weeks' when u in ('years', 'year') then w::varchar || ' weeks' else w::bigint::varchar || ' weeks' end a from w where w is not null) group by 1)
select k.doc_id, coalesce(c, 'age classification not possible') as classes, coalesce(a, age) as ages from {_CLEANED} k left join c on c.doc_id = k.doc_id left join a on a.doc_id = k.doc_id""")
def _(s, d):
    return _said(s, d).select("doc_id", A.classified_ages(A.cleaned_ages(F.col("raw"))).alias("x")).select("doc_id", "x.classes", "x.ages")


@query("f33_lost_dash", rf"select distinct age, n, case when n > 150 and length(n::varchar) = 3 then left(n::varchar, 1) || '-' || substr(n::varchar, 2) when n > 150 then left(n::varchar, 2) || '-' || substr(n::varchar, 3) else n::varchar end as repaired from (select trim(x) age, try_cast(split_part(trim(x), ' ', 1) as int) n from (select unnest(string_split(age, ', ')) x from {_CLEANED})) where n is not null")
def _(s, d):
    ages = _said(s, d).select(F.explode(F.split(A.cleaned_ages(F.col("raw")), ", ")).alias("age")).distinct()
    return ages.withColumn("n", F.regexp_extract("age", r"^(\S+)", 1).try_cast("int")).where("n is not null").select("age", "n", B.lost_dash(F.col("n")).alias("repaired"))


_WEEKLY = rf"(select doc_id, text, trim(x) age_str, try_cast(split_part(trim(x), ' ', 1) as double) age_num, lower(split_part(trim(x), ' ', 2)) age_unit from (select doc_id, text, unnest(string_split(age, ',')) x from {_CLEANED} where not regexp_matches(age, '\d+\s*[-–]\s*\d+') and contains(lower(raw), 'days')) where try_cast(split_part(trim(x), ' ', 1) as double) is not null)"


def _weekly(s, d):
    """The texts give hardly any age in weeks, so the unit is days here."""
    return A.weekly_ages(_said(s, d).withColumn("age", A.cleaned_ages(F.col("raw"))), ["doc_id", "text"], "age", "raw", "days")


@query("f35_weekly_ages", f"select doc_id, age_str, age_num, age_unit from {_WEEKLY}")
def _(s, d):
    return _weekly(s, d).drop("text")


@query("f34_resolved_ages", rf"""select doc_id, age, case when kept then age when regexp_full_match(age, '\d\d') and regexp_matches(text, '(?i)\b' || age[1] || '\s*(to|-|–|—)\s*' || age[2] || '\s*(weeks?|wks?|months?|mos?|days?)?\b') then age[1] || '-' || age[2] else age end || ' ' || age_unit as resolved
from (select *, regexp_matches(text, '(?i)\b' || age || '\b\s*([^%\w\s]|$)') or regexp_matches(text, '(?i)\b' || age || '[-\s]?\s*(weeks?|wks?|months?|mos?|days?)([-\s]?old)?\b\s*([^%\s]|$)') kept from (select *, split_part(age_str, ' ', 1) age from {_WEEKLY}))""")
def _(s, d):
    rows = _weekly(s, d).withColumn("age", F.regexp_extract("age_str", r"^(\S+)", 1))
    return rows.select("doc_id", "age", A.resolved_age(F.col("text"), F.col("age"), F.col("age_unit")).alias("resolved"))


@query("f36_animal_numbers", rf"select annotation_row_id, try_cast(regexp_extract(animal_number, '^(?:n = )?(\d+)$', 1) as double) as n from {ANN}")
def _(s, d):
    return table(s, d, ANN).select("annotation_row_id", B.number_of(F.col("animal_number")).alias("n"))


@query("f18_last_segment", f"select annotation_row_id, trim(string_split(first_author_country, ',')[-1]) as last from {ANN} where first_author_country is not null")
def _(s, d):
    return table(s, d, ANN).where("first_author_country is not null").select("annotation_row_id", F.trim(F.element_at(F.split("first_author_country", ","), -1)).alias("last"))


@query("f15_rsplit", f"select rec_id, regexp_replace(doc_id, '_[^_]*$', '') as study from {NER}")
def _(s, d):
    return table(s, d, NER).select("rec_id", F.regexp_replace("doc_id", r"_[^_]*$", "").alias("study"))


@query("f21_article_number", f"select meta_row_id, try_cast(regexp_extract(pmid, '(?i)^\\s*(?:pmid)?\\s*:?\\s*0*([0-9]+)(?:\\.0*)?\\s*$', 1) as bigint) as article from {META}")
def _(s, d):
    return table(s, d, META).select("meta_row_id", article(F.col("pmid")).alias("article"))


_TAGS = "[upper(trim(string_split(x, '|')[1])) for x in ner_tags]"


@query("f61_tag_counts", f"select tag, count(*) as n from (select unnest({_TAGS}) tag from {NER}) group by 1")
def _(s, d):
    tags = F.transform("ner_tags", lambda x: F.upper(F.trim(F.split(x, r"\|")[0])))
    return table(s, d, NER).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("f60_entity_spans", f"with t as (select rec_id, i, tokens[i] tok, upper(trim(string_split(ner_tags[i], '|')[1])) tag from (select * from {NER} where tokens is not null and ner_tags is not null), unnest(range(1, least(len(tokens), len(ner_tags)) + 1)) r(i)), k as (select *, split_part(tag, '-', 2) kind, lag(tag) over (partition by rec_id order by i) prev from t), g as (select *, sum(case when tag like 'I-%' and split_part(coalesce(prev, 'O'), '-', 2) = kind then 0 else 1 end) over (partition by rec_id order by i) grp from k) select rec_id, min(i)::int as begin, kind, replace(string_agg(coalesce(tok, ''), ' ' order by i), ' ##', '') as entity from g where tag <> 'O' group by rec_id, grp, kind")
def _(s, d):
    """Tokens grouped to entities: one fold over each record's tags, no window and no shuffle."""
    n = F.least(F.size("tokens"), F.size("ner_tags"))
    tag = F.transform("ner_tags", lambda x: F.upper(F.trim(F.split(x, r"\|")[0])))
    t = table(s, d, NER).where("tokens is not null and ner_tags is not null").select("rec_id", F.slice(F.arrays_zip("tokens", tag.alias("tag")), F.lit(1), n).alias("z"))
    t = t.select("rec_id", F.transform("z", lambda x, i: F.struct((i + 1).alias("i"), F.coalesce(x["tokens"], F.lit("")).alias("tok"), F.split_part(x["tag"], F.lit("-"), F.lit(2)).alias("kind"), x["tag"].startswith("I-").alias("inside"))).alias("z"))
    one = "array<struct<begin:int,stop:int,kind:string,entity:string>>"
    fold = F.aggregate(
        F.filter("z", lambda x: x["kind"] != ""),
        F.array().cast(one),
        lambda acc, x: F.when(
            x["inside"] & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(-9)) == x["i"] - 1) & (F.try_element_at(acc, F.lit(-1))["kind"] == x["kind"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["begin"].alias("begin"), x["i"].alias("stop"), x["kind"].alias("kind"), F.concat(F.try_element_at(acc, F.lit(-1))["entity"], F.when(x["tok"].startswith("##"), F.substring(x["tok"], 3, 1_000_000)).otherwise(F.concat(F.lit(" "), x["tok"]))).alias("entity")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["i"].alias("begin"), x["i"].alias("stop"), x["kind"].alias("kind"), x["tok"].alias("entity"))))),
    )
    return t.select("rec_id", F.explode(fold).alias("e")).select("rec_id", "e.begin", "e.kind", "e.entity")


@query("f63_multi_hot", f"select annotation_row_id, array_to_string([list_contains([trim(x) for x in string_split(lower(assay_type), ',')], y)::int for y in ['behavior', 'histology', 'imaging']], ',') as assays, array_to_string([(lower(trim(animal_species)) = y)::int for y in ['mouse', 'rat', 'rabbit', 'monkey', 'guinea pig', 'species-other', 'dog', 'cat', 'pig']], ',') as species from {ANN} where assay_type is not null and animal_species is not null")
def _(s, d):
    """A flag for each label, in a fixed order."""
    cell = lambda c: F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x))
    hot = lambda c, labels: F.array_join(F.transform(F.array(*map(F.lit, labels)), lambda y: F.array_contains(cell(c), y).cast("int").cast("string")), ",")
    return table(s, d, ANN).where("assay_type is not null and animal_species is not null").select("annotation_row_id", hot("assay_type", ("behavior", "histology", "imaging")).alias("assays"), hot("animal_species", K.SPECIES_ORDER).alias("species"))


@query("f61_filtered_tags", f"with p as (select rec_id, [[y for y in list_distinct([trim(z) for z in string_split(upper(x), '|')]) if y in ('B-DRUG', 'I-DRUG', 'B-DISEASE', 'I-DISEASE')] for x in ner_tags] l from (select rec_id, [coalesce(x, 'O') for x in ner_tags] ner_tags from {NER} where ner_tags is not null)), q as (select rec_id, [case when len(x) = 0 then 'O' else array_to_string(list_sort([y for y in x if y like 'B-%' or not list_contains(x, 'B-' || y[3:])]), '|') end for x in l] t from p) select rec_id, replace(array_to_string(t, ' '), 'DISEASE', 'CONDITION') as tags, len([x for x in t if x = 'B-DRUG']) as drugs, len([x for x in t if x = 'B-DISEASE']) as conditions from q")
def _(s, d):
    """Tags of drugs and diseases only, ``B`` before ``I`` of one kind, kinds renamed, and how many begin."""
    kept = B.filtered_tags(F.transform("ner_tags", lambda x: F.coalesce(x, F.lit("O"))), ["DRUG", "DISEASE"])
    t = table(s, d, NER).where("ner_tags is not null").select("rec_id", kept.alias("t"))
    count = lambda v: F.size(F.filter("t", lambda x: x == v)).cast("bigint")
    return t.select("rec_id", F.replace(F.array_join("t", " "), F.lit("DISEASE"), F.lit("CONDITION")).alias("tags"), count("B-DRUG").alias("drugs"), count("B-DISEASE").alias("conditions"))


@query("f72_sentence_split", f"select doc_id, sentence_id::int as sentence_id, sentence from {_SENT}")
def _(s, d):
    return _rows(s, d)


@query("t02_sentences_per_document", f"select doc_id, count(*) as sentences, sum(length(sentence))::bigint as chars from {_SENT} group by 1")
def _(s, d):
    rows = _rows(s, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"))

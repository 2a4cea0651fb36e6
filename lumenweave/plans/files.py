"""Queries over sources, sinks and incremental runs: each writes a whole table in a format and reads it again."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import functions as F

from lumenweave.operators import classify as K
from lumenweave.plans.registry import Registry
from lumenweave.plans.training import ANNOTATIONS as ANN
from lumenweave.plans.training import METADATA as META
from lumenweave.session import fresh_path, table
from lumenweave.sources import files as S
from lumenweave.sources.sections import grouped_by_span, sections
from lumenweave.streaming.incremental import run_available, run_distinct

NER = "drug_disease_ner"
query = Registry()

_CSV = f"select annotation_row_id, nullif(animal_strain, '') as animal_strain, year from {ANN}"


@query("s01_csv_scan", _CSV)
def _(s, d):
    S.write_csv(table(s, d, ANN).select("annotation_row_id", "animal_strain", "year"), p := fresh_path(s, "csv"))
    return S.read_csv(s, p, "annotation_row_id bigint, animal_strain string, year int").withColumn("animal_strain", F.nullif("animal_strain", F.lit("")))


@query("s02_csv_strings", f"select annotation_row_id::varchar as annotation_row_id, year::varchar as year from {ANN}")
def _(s, d):
    S.write_csv(table(s, d, ANN).select("annotation_row_id", "year"), p := fresh_path(s, "csv"), one_file=True)
    return S.read_strings(s, p, ["annotation_row_id", "year"])


@query("s03_incremental_run", f"select doc_id, coalesce(regexp_matches(text, '(?i){K.BLINDING}'), false)::int as code from documents")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    src, out, log = (fresh_path(s, n) for n in ("stream-in", "stream-out", "stream-log"))
    rule = lambda df: df.select("doc_id", K.blinding(F.col("text")).alias("code"))
    docs.where("doc_id % 2 = 0").write.parquet(src)
    run_available(s, src, "doc_id bigint, text string", rule, out, log)
    docs.where("doc_id % 2 <> 0").write.mode("append").parquet(src)
    run_available(s, src, "doc_id bigint, text string", rule, out, log)
    return s.read.parquet(out)


@query("s03_stream_distinct", "select event_id, event_type from events")
def _(s, d):
    e = table(s, d, "events").select("event_id", "event_type", "ts")
    src, out, log = (fresh_path(s, n) for n in ("stream-in", "stream-out", "stream-log"))
    e.union(e).write.parquet(src)
    run_distinct(s, src, "event_id bigint, event_type string, ts timestamp", ["event_id"], "ts", "60 days", out, log)
    return s.read.parquet(out).select("event_id", "event_type")


@query("s04_headerless_csv", "select o_orderkey, o_orderstatus from orders")
def _(s, d):
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.csv(p := fresh_path(s, "csv"))
    return S.read_csv(s, p, "o_orderkey bigint, o_orderstatus string", header=False)


@query("s05_delimited_records", f"select pmid, year::varchar as year, nullif(publication_type, 'N/A') as publication_type from {META} where pmid not like '%\t%' and meta_row_id % 9 <> 0")
def _(s, d):
    m = table(s, d, META).where("pmid not like '%\t%'")
    whole = F.concat_ws("|||", "pmid", F.coalesce(F.col("year").cast("string"), F.lit("N/A")), F.coalesce("publication_type", F.lit("N/A")))
    line = F.when(F.col("meta_row_id") % 9 == 0, F.col("pmid")).otherwise(whole)
    m.select(line).write.text(p := fresh_path(s, "text"))
    return S.read_records(s, p, ["pmid", "year", "publication_type"]).drop("chunk")


@query("s06_folder_union", "select n_nationkey, n_name from nation union all select r_regionkey, r_name from region")
def _(s, d):
    root = fresh_path(s, "folders")
    S.write_csv(table(s, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")), f"{root}/x")
    S.write_csv(table(s, d, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b")), f"{root}/y")
    return S.read_csv(s, [f"{root}/x", f"{root}/y"], "n_nationkey int, n_name string")


@query("s08_json_lines", f"select rec_id, doc_id, tokens[1] as first_token from {NER}")
def _(s, d):
    S.write_jsonl(table(s, d, NER).select("rec_id", "doc_id", "tokens"), p := fresh_path(s, "json"))
    return s.read.schema("rec_id bigint, doc_id string, tokens array<string>").json(p).select("rec_id", "doc_id", F.get("tokens", F.lit(0)).alias("first_token"))


@query("s09_json_array", "select s_suppkey, s_name from supplier")
def _(s, d):
    t = table(s, d, "supplier").select("s_suppkey", "s_name")
    p = fresh_path(s, "json")
    arrays = t.where("s_suppkey % 2 = 0").groupBy(F.pmod("s_suppkey", F.lit(8)).alias("g")).agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value"))
    arrays.write.partitionBy("g").text(f"{p}/arrays")
    t.where("s_suppkey % 2 <> 0").write.json(f"{p}/lines")
    return S.read_json_any(s, [f"{p}/arrays/*", f"{p}/lines"], "s_suppkey bigint, s_name string")


def _put(s, path: str, data: bytes) -> None:
    """A file of these bytes in the shared folder."""
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(s._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def _zipped(files: dict[str, str | bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return buffer.getvalue()


@query("s10_zipped_catalogue", "select n_nationkey::varchar as key, n_name as name, n_regionkey::int as region from nation")
def _(s, d):
    """A catalogue of records by id in two archives; the fixed table of 25 nations is written on the driver."""
    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    root = fresh_path(s, "zip")
    for k in range(2):
        _put(s, f"{root}/part{k}.zip", _zipped({"records.json": json.dumps({str(r[0]): {"name": r[1], "region": r[2]} for r in rows if r[0] % 2 == k})}))
    return S.read_zipped_json(s, f"{root}/*.zip", "name string, region int")


@query("s11_workbook_sheets", "select 'sheet1' as sheet, 1 + row_number() over (order by r_regionkey) as row, r_name as cell from region union all select 'sheet1', 1, 'name'")
def _(s, d):
    """A workbook of one sheet, its first column; the fixed table of five regions is written on the driver."""
    names = ["name", *(r[0] for r in table(s, d, "region").orderBy("r_regionkey").select("r_name").collect())]
    rows = "".join(f'<row r="{i}"><c t="s"><v>{i - 1}</v></c></row>' for i in range(1, len(names) + 1))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = {"xl/sharedStrings.xml": f"<sst {space}>" + "".join(f"<si><t>{escape(n)}</t></si>" for n in names) + "</sst>", "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>"}
    _put(s, path := f"{fresh_path(s, 'xlsx')}/book.xlsx", _zipped(book))
    return S.read_sheets(s, path).select("sheet", F.col("row").cast("bigint").alias("row"), F.get("cells", F.lit(0)).alias("cell"))


@query("s14_vector_batches", "select n_nationkey // 10 as batch, n_nationkey % 10 as row, n_nationkey::double as first, n_regionkey::double as second from nation")
def _(s, d):
    """Matrices of ten rows a file; the fixed table of 25 nations is written on the driver."""
    rows = sorted(tuple(r) for r in table(s, d, "nation").select("n_nationkey", "n_regionkey").collect())
    root = fresh_path(s, "npy")
    for k in range(0, len(rows), 10):
        np.save(buffer := io.BytesIO(), np.array(rows[k : k + 10], np.float32))
        _put(s, f"{root}/batch_{k // 10}.npy", buffer.getvalue())
    number = F.regexp_extract("file", r"_(\d+)\.npy", 1).cast("bigint")
    return S.read_vectors(s, f"{root}/*.npy").select(number.alias("batch"), "row", F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(1)).cast("double").alias("second"))


@query("s12_xml_records", "select p_partkey, p_brand from part")
def _(s, d):
    table(s, d, "part").select("p_partkey", "p_brand").write.format("xml").option("rootTag", "parts").option("rowTag", "part").save(p := fresh_path(s, "xml"))
    return S.read_xml(s, p, "part", "p_partkey bigint, p_brand string")


@query("s12_nested_records", "select cui as id, min(lower(str)) as name, array_to_string(list_sort(list_distinct(list(lower(trim(str))))), '|') as names from umls_concepts where str is not null and trim(str) = str and not regexp_matches(str, '  ') group by 1")
def _(s, d):
    """Records with a name and nested synonyms, flattened to the sorted union of their names."""
    t = table(s, d, "umls_concepts").where("str is not null and trim(str) = str and not (str rlike '  ')").groupBy(F.col("cui").alias("id")).agg(F.min(F.lower("str")).alias("name"), F.struct(F.collect_set(F.lower("str")).alias("synonym")).alias("synonyms"))
    t.write.format("xml").option("rootTag", "drugs").option("rowTag", "drug").save(p := fresh_path(s, "xml"))
    back = S.read_xml(s, p, "drug", "id string, name string, synonyms struct<synonym:array<string>>")
    every = F.concat(F.array("name"), F.coalesce("synonyms.synonym", F.array().cast("array<string>")))
    return back.select("id", "name", F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda x: F.trim(x)))), "|").alias("names"))


@query("s13_first_name_wins", "with n as (select id, lower(name) n, 0 p, 0 i from ontology_terms union all select id, lower(x.text), 1, i from (select id, synonyms[i] x, i from ontology_terms, unnest(range(1, len(synonyms) + 1)) r(i)) where x.scope <> 'BROAD') select n as name, split_part(min(p || '#' || id), '#', 2) as id from n group by 1")
def _(s, d):
    t = table(s, d, "ontology_terms")
    own = t.select(F.lower("name").alias("name"), F.lit(0).alias("p"), "id")
    syn = t.select("id", F.explode("synonyms").alias("x")).where("x.scope <> 'BROAD'").select(F.lower("x.text").alias("name"), F.lit(1).alias("p"), "id")
    return own.union(syn).groupBy("name").agg(F.min(F.struct("p", "id")).alias("m")).select("name", "m.id")


@query("s16_single_csv", "select c_mktsegment, count(*) as n from customer group by 1")
def _(s, d):
    S.write_csv(table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), p := fresh_path(s, "csv"), one_file=True)
    return S.read_csv(s, p, "c_mktsegment string, n bigint")


@query("s18_zstd_parquet", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def _(s, d):
    S.write_zstd(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), p := fresh_path(s, "parquet"))
    return s.read.parquet(p)


@query("s19_per_key_files", "select o_orderpriority, count(*) as n, sum(o_totalprice)::bigint as total from orders group by 1")
def _(s, d):
    S.write_by_key(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), p := fresh_path(s, "keys"), "o_orderpriority")
    return s.read.parquet(p).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).cast("bigint").alias("total"))


@query("s20_summary_text", f"select 'rows: ' || count(*) || ', journals: ' || count(distinct journal_name) as value from {META}")
def _(s, d):
    t = table(s, d, META).agg(F.concat(F.lit("rows: "), F.count("*").cast("string"), F.lit(", journals: "), F.countDistinct("journal_name").cast("string")).alias("value"))
    t.coalesce(1).write.text(p := fresh_path(s, "text"))
    return s.read.text(p)


@query("s22_merged_chunks", "select event_id, event_type from events")
def _(s, d):
    S.write_chunks(table(s, d, "events").select("event_id", "event_type"), p := fresh_path(s, "chunks"), 1000)
    return S.read_csv(s, p, "event_id bigint, event_type string")


@query("f67_method_sections")
def _(s, d):
    return sections(table(s, d, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


@query("f68_html_to_text", "select doc_id, trim(regexp_replace(regexp_replace(text, '</?p>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')) as plain from documents where contains(text, '<p>')")
def _(s, d):
    t = table(s, d, "documents").where(F.contains("text", F.lit("<p>")))
    return t.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("text", "</?p>", " "), r"[ \n\t\r]+", " ")).alias("plain"))


@query("f70_spans_by_heading", r"""with p as (select doc_id, i, string_split(text, chr(10) || chr(10)) s from documents, unnest(range(1, 2)) r(i) where text is not null), b as (select doc_id, j, s[j] t, length(array_to_string(s[1:j - 1], chr(10) || chr(10))) as at from p, unnest(range(1, len(s) + 1)) r(j)),
k as (select doc_id, j, t, trim(t) <> '' and length(t) <= 40 and not contains(t, '.') h from b), g as (select doc_id, j, t, h, last_value(case when h then t end ignore nulls) over (partition by doc_id order by j rows between unbounded preceding and current row) x from k)
select doc_id, x as heading, count(*) as paragraphs from g where not h and trim(t) <> '' group by 1, 2""")
def _(s, d):
    """Paragraphs of each heading; a short piece without a full stop is a heading."""
    pieces = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "text")).where("trim(text) <> ''")
    short = (F.length("text") <= 40) & ~F.contains("text", F.lit("."))
    return grouped_by_span(pieces.where(~short), pieces.where(short), "doc_id", "at").groupBy("doc_id", "heading").agg(F.count("*").alias("paragraphs"))

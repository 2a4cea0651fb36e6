"""Readers and writers for the file formats of the pipeline."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with an explicit schema; fields may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep, multiLine=True, escape='"')


def read_strings(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV with every column a string."""
    return read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns), header)


def read_records(spark: SparkSession, path: str | list[str], fields: Sequence[str], sep: str = "|||", only: DataFrame | None = None) -> DataFrame:
    """Lines of fields parted by ``sep``; lines with another number of fields are dropped; ``N/A`` is null. ``chunk`` is the file.

    ``only`` keeps the records whose first field is among its first column.
    """
    parts = F.split("value", re.escape(sep))
    rows = spark.read.text(path).select(parts.alias("f"), F.col("_metadata.file_name").alias("chunk")).where(F.size("f") == len(fields))
    out = rows.select(*[F.nullif(F.col("f")[i], F.lit("N/A")).alias(n) for i, n in enumerate(fields)], "chunk")
    return out if only is None else out.join(only.select(F.col(only.columns[0]).alias(fields[0])).distinct(), fields[0], "left_semi")


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a number in their name, which comes as ``chunk``."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.select("*", F.regexp_extract("_metadata.file_name", r"_(\d+)\.csv", 1).cast("int").alias("chunk"))


def read_json_any(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON Lines, or one array of records a file: told apart by the first character of each file.

    Only the first line of each file is needed to tell them apart, so lines are read as lines, in splits, and only files that hold an array
    are read whole, one file a row.
    """
    struct = T._parse_datatype_string(schema).simpleString()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = lines.where((F.col("at") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.bool_or(F.ltrim("value").rlike(r"^\[\s*(?:\{|\]|$)")).alias("array"))
    arrays = [r["file"] for r in heads.where("array").collect()]
    one = lines.where(~F.col("file").isin(arrays) if arrays else F.lit(True)).where("trim(value) <> ''").select(F.from_json("value", struct).alias("r"))
    if arrays:
        whole = spark.read.text(arrays, wholetext=True)
        one = one.union(whole.select(F.explode(F.from_json("value", f"array<{struct}>")).alias("r")))
    return one.select("r.*")


def read_zipped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Zip archives of JSON objects keyed by record id: the id as ``key`` and the record's fields."""
    struct = T._parse_datatype_string(schema).simpleString()

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        records = json.loads(z.read(name))
                        yield pd.DataFrame([(k, json.dumps(v)) for k, v in records.items()], columns=["key", "record"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "key string, record string")
    return raw.select("key", F.from_json("record", struct).alias("r")).select("key", "r.*")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbooks: sheet, row (from 1), cells ARRAY<STRING>. Only what XML in the archive says; no formulas are computed."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
                    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                        rows = []
                        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.endswith("}row")):
                            got = []
                            for c in row:
                                v = next((e for e in c.iter() if e.tag.endswith("}v") or e.tag.endswith("}t")), None)
                                text = None if v is None else v.text
                                got.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                            rows.append((name[14:-4], int(row.get("r", len(rows) + 1)), got))
                        yield pd.DataFrame(rows, columns=["sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "sheet string, row int, cells array<string>")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``.npy`` matrices: file, row (from 0), vector ARRAY<FLOAT>."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["file"], b["content"]):
                m = np.load(io.BytesIO(data), allow_pickle=False)
                for a in range(0, len(m), 4096):
                    part = m[a : a + 4096].astype(np.float32)
                    yield pd.DataFrame({"file": name, "row": range(a, a + len(part)), "vector": list(part)})

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInPandas(load, "file string, row bigint, vector array<float>")


def fetch(ids: DataFrame, key: str, get: Callable[[str], str | None], done: DataFrame | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Content of each id by a function of the caller's, with retries and growing waits: key, content, error. Ids in ``done`` are left out."""
    todo = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b[key]:
                content, error = None, None
                for t in range(tries):
                    try:
                        content, error = get(k), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        time.sleep(wait * 2**t if t + 1 < tries else 0)
                rows.append((k, content, error))
            yield pd.DataFrame(rows, columns=[key, "content", "error"])

    return todo.mapInPandas(run, f"{key} string, content string, error string")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.csv(path, header=True, escape='"', mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_chunks(df: DataFrame, path: str, rows: int) -> None:
    """CSV files of at most so many rows."""
    df.write.option("maxRecordsPerFile", rows).csv(path, header=True, mode="overwrite")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def write_zstd(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path, mode="overwrite")


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder a key; rows of a key are gathered before, so that it has few files, but a large key may have several.

    Rows are dealt by the hash of all their columns, so a task that runs again gets the same ones.
    """
    df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(4))).repartition(key, "__salt").drop("__salt").write.partitionBy(key).parquet(path, mode="overwrite")

"""What surrounds models: batches in, checked and aligned results out. The models themselves are the caller's functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a chunk for token models.
CHUNK = 505


def classify_texts(df: DataFrame, row_id: str, text: str, logits: Callable[[list[str]], np.ndarray], labels: Sequence[str], batch: int = 64) -> DataFrame:
    """Label and confidence (greatest softmax) of each text: row_id, label, confidence. Null texts have neither; of ties the first label holds."""
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, sure = [None] * len(b), [None] * len(b)
            some = [i for i, t in enumerate(b["text"]) if t is not None]
            for a in range(0, len(some), batch):
                own = some[a : a + batch]
                z = np.asarray(logits([b["text"].iloc[i] for i in own]), float).reshape(len(own), len(labels))
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, k, c in zip(own, p.argmax(axis=1), p.max(axis=1)):
                    said[i], sure[i] = labels[k], float(c)
            yield pd.DataFrame({"row_id": b["row_id"], "label": said, "confidence": pd.array(sure, "Float64")})

    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"row_id {kind}, label string, confidence double")


def tag_words(df: DataFrame, row_id: str, text: str, tag: Callable[[list[str]], list[str]], chunk: int = CHUNK) -> DataFrame:
    """Words other than ``O`` with their places in the whole text: row_id, begin, stop, word, tag.

    A text is read in chunks of ``chunk`` words, and places are shifted back. Words are runs without white space. Null texts give none.
    """
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["row_id"], b["text"]):
                at, words = 0, []
                for w in t.split():
                    at = t.index(w, at)
                    words.append((at, w))
                    at += len(w)
                for a in range(0, len(words), chunk):
                    part = words[a : a + chunk]
                    out += [(k, p, p + len(w), w, g) for (p, w), g in zip(part, tag([w for _, w in part])) if g != "O"]
            yield pd.DataFrame(out, columns=["row_id", "begin", "stop", "word", "tag"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"row_id {kind}, begin int, stop int, word string, tag string")


def generate(df: DataFrame, row_id: str, text: str, answer: Callable[[str, int], str | None], valid: Callable[[str, str], bool], tries: int = 3) -> DataFrame:
    """Answers that hold the caller's test: row_id, answer, valid, attempts. Without one, the longest attempt; errors are attempts without answer."""
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["row_id"], b["text"]):
                best, good, n = None, False, 0
                for n in range(1, tries + 1):
                    try:
                        got = answer(t, n)
                    except Exception:  # noqa: BLE001
                        got = None
                    if got is not None and valid(t, got):
                        best, good = got, True
                        break
                    if got is not None and len(got) > len(best or ""):
                        best = got
                out.append((k, best, good, n))
            yield pd.DataFrame(out, columns=["row_id", "answer", "valid", "attempts"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"row_id {kind}, answer string, valid boolean, attempts int")


def constrained(answered: Column, original: Column) -> Column:
    """An answered list if all of it is in the original list, else the original; null and empty answers too give the original."""
    fits = (F.size(answered) > 0) & (F.size(F.array_except(answered, original)) == 0)
    return F.when(F.coalesce(fits, F.lit(False)), answered).otherwise(original)


def json_of(text: Column) -> Column:
    """The JSON object of an answer: inside ``<json>`` tags, else inside a fence, else the last object without inner ones; null if none parses."""
    tagged = F.regexp_extract(text, r"(?is)<json>\s*(.*?)\s*</json>", 1)
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), F.lit(-1))
    good = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(good(tagged), good(fenced), good(last))


def text_labels(train: DataFrame, texts: DataFrame, text: str, label: str, features: int = 1 << 16) -> DataFrame:
    """``texts`` with ``predicted``: linear support vectors, one against the rest, over weighted words, fitted on ``train``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    steps = [RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[\p{L}\p{N}]+", gaps=False), HashingTF(inputCol="__w", outputCol="__n", numFeatures=features), IDF(inputCol="__n", outputCol="__x", minDocFreq=2)]
    fitted = Pipeline(stages=[*steps, OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), featuresCol="__x", labelCol="__y", predictionCol="__p")]).fit(index.transform(train))
    named = IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels)
    return named.transform(fitted.transform(texts)).select(*texts.columns, "predicted")

"""Language of documents and of their stretches, by fusing the evidence of text, label and place of origin."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import squeeze
from lumenweave.operators.skew import split_join
from lumenweave.session import spread

# The languages and the ways to write them. Regions (de-AT) and case don't matter.
LANGS = ("de", "en", "es", "fr", "it", "pt")
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
}
KNOWN = {name: lang for lang, names in NAMES.items() for name in names.split()}

#: Country endings of addresses, by the language mostly written there.
ENDINGS = {"de": "de at", "en": "uk us ie au nz", "es": "es mx ar cl co pe uy ve", "fr": "fr", "it": "it sm va", "pt": "pt br ao mz"}
SUFFIX = {end: lang for lang, ends in ENDINGS.items() for end in ends.split()}

#: The model is fitted on at most this many labelled rows of each language.
FIT_ROWS = 300
FIT_ROUNDS = 3
#: Trust in a label, in the markup and in the ending of the address where they name one of the languages, pseudo-counts of the level above,
#: chance that the language changes between two sentences, and the weight of one word's evidence (words of a sentence are not independent).
TRUST, MARKUP_TRUST, SUFFIX_TRUST, PRIOR_WEIGHT, CHANGE, SHARPNESS = 0.8, 0.9, 0.6, 20.0, 0.01, 0.5
#: Sentences in a row that put a language into a text; fewest words of a sentence.
IN_A_ROW, LEAST_WORDS = 2, 4
#: A stretch is in another language than these where fewer than this share of the words that is usual in its best language belong to it.
FOREIGN = 0.5
#: A word doesn't belong to a language where it is so much likelier in another (logarithm).
UNFIT = -2.3
#: Unknown words whose scores a worker keeps.
KEPT_WORDS = 200_000

WORD = re.compile(r"[^\W\d_]+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
QUOTED = re.compile(r"[\(\[]*(?:cf\.\s*)?[“«„][^“”«»„]*[”»“][\)\]]*\.?|\"[^\"\n]+\"")
ASIDE = re.compile(r"[\(\[][^()\[\]]*[\)\]]")
BREAK = re.compile(r"(?<=[.!?…])[\"”»’)\]]*\s+|\n\s*\n|\x0c")
END = re.compile(r"[.!?…][\"”»’)\]]*\s*$")
HYPHEN = re.compile(r"-\s*\n\s*")


def declared(label: Column) -> Column:
    """The language that a label names: one of ``LANGS``, ``other`` for another, null where it says nothing."""
    head = F.lower(F.regexp_extract(squeeze(label), r"^([\p{L}]+)(?:[-_ (].*)?$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    nothing = label.isNull() | head.isin("", "und", "unknown", "n", "na", "nan", "none", "null", "mis", "mul", "zxx", "xx", "unk", "unspecified", "undetermined", "other", "missing", "not")
    return F.when(nothing, F.lit(None).cast("string")).otherwise(F.coalesce(pairs[head], F.lit("other")))


def from_markup(text: Column) -> Column:
    """The language that the markup of a text declares (``<html lang="de-AT">``), as ``declared`` gives it; null without markup."""
    said = F.regexp_extract(text, r"(?i)<[a-z]+\s[^<>]*?\b(?:xml:)?lang\s*=\s*[\"']?([\p{L}-]+)", 1)
    return F.when(F.contains(text, F.lit("<")), declared(said))


def from_address(address: Column) -> Column:
    """The language mostly written where an address (host or URL) ends; null where the ending says nothing."""
    end = F.regexp_extract(F.lower(F.trim(address)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?[^/:?#\s]*\.([a-z]{2,})\.?(?:[:/?#].*)?$", 1)
    return F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])[end]


def blanked(text: str) -> str:
    """The text with tags, quotations, a title before `` | `` and hyphenation made blank, every character in its place.

    What stands before the first bar is a title unless it has a blank line or as many sentence ends as put a language into a text.
    """
    text = text.replace("\r", " ")
    space = lambda m: " " * (m.end() - m.start())
    if "<" in text:
        text = TAG.sub(lambda m: "\n\n" + " " * (m.end() - m.start() - 2), text)
    text = QUOTED.sub(space, text)
    bar = text.find(" | ")
    if bar >= 0 and "\n\n" not in (head := text[:bar].strip()) and sum(1 for _ in BREAK.finditer(head)) < IN_A_ROW:
        text = "\n" * (bar + 3) + text[bar + 3 :]
    return text


def units(text: str) -> list[tuple[int, int, list[str], bool]]:
    """Begin, end, words and whether it is a whole sentence, of each stretch between sentence ends."""
    out, begin = [], 0
    text = blanked(text)
    spans = []
    for m in BREAK.finditer(text):
        spans.append((begin, m.end()))
        begin = m.end()
    spans.append((begin, len(text)))
    for a, b in spans:
        body = piece = text[a:b]
        if "(" in piece or "[" in piece:
            body = ASIDE.sub(" ", piece)
        if "-" in body and "\n" in body:
            body = HYPHEN.sub("", body)
        if "&" in body:
            body = html.unescape(body)
        words = WORD.findall(body.lower())
        if words:
            out.append((a, b, words, len(words) >= LEAST_WORDS and bool(END.search(piece))))
    return out


class Model:
    """Log-likelihoods of words by language, of letter triples for words not seen, and the share of words that is usual in each language."""

    def __init__(self, words: dict[str, int], logs: np.ndarray, triples: dict[str, int], triple_logs: np.ndarray, usual: np.ndarray | None = None):
        self.words, self.logs, self.triples, self.triple_logs = words, logs, triples, triple_logs
        self.usual = np.zeros(len(LANGS)) if usual is None else usual
        self._ids: dict[str, int] = dict(words)
        self._rows = logs.astype(np.float64)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("words", "logs", "triples", "triple_logs", "usual")}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _learn(self, unseen: set[str]) -> None:
        """Adds rows of unknown words by their letter triples."""
        if len(self._ids) + len(unseen) > len(self.words) + KEPT_WORDS:
            self._ids, self._rows = dict(self.words), self.logs.astype(np.float64)
        rows = np.empty((len(unseen), len(LANGS)))
        for k, w in enumerate(unseen):
            t = f" {w} "
            own = self.triple_logs[[self.triples.get(t[i : i + 3], 0) for i in range(len(t) - 2)]].sum(axis=0, dtype=np.float64) * 0.3
            rows[k] = np.maximum(own - own.max(), -2.0)
            self._ids[w] = len(self._rows) + k
        self._rows = np.concatenate([self._rows, rows])

    def score(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence the evidence of its different words, the best language at 0; and the share of them that belong to that language."""
        if not sentences:
            return np.zeros((0, len(LANGS))), np.zeros(0)
        sets = [set(s) for s in sentences]
        unseen = set().union(*sets) - self._ids.keys()
        if unseen:
            self._learn(unseen)
            if len(self._ids) <= len(self.words) + len(unseen):  # begun anew: words known before may be gone
                gone = set().union(*sets) - self._ids.keys()
                if gone:
                    self._learn(gone)
        ids = self._ids
        flat = np.array([ids[w] for s in sets for w in s], np.int64)
        begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
        total = np.add.reduceat(self._rows[flat], begin)
        best = total.argmax(axis=1)
        counts = np.diff([*begin, len(flat)])
        fits = (flat < len(self.words)) & (self._rows[flat, np.repeat(best, counts)] > UNFIT)
        return total - total.max(axis=1, keepdims=True), np.add.reduceat(fits, begin, dtype=np.int64) / counts


def _model(sentences: list[list[str]], labels: list[int]) -> Model:
    n = len(LANGS)
    counts: list[Counter] = [Counter() for _ in LANGS]
    for s, k in zip(sentences, labels):
        counts[k].update(s)
    words = sorted(set().union(*counts))
    table = np.array([[c[w] for c in counts] for w in words], float).reshape(-1, n)
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
    for w, row in zip(words, np.minimum(table, 5)):
        t = f" {w} "
        for i in range(len(t) - 2):
            grams[t[i : i + 3]] += row

    def logs(rows: np.ndarray, alpha: float) -> np.ndarray:
        p = np.log((rows + alpha) / (rows.sum(axis=0) + alpha * max(1, len(rows))))
        return (p - p.max(axis=1, keepdims=True)).astype(np.float32) if len(rows) else np.zeros((1, n), np.float32)

    keep = [i for i in range(len(words)) if table[i].sum() >= 2]
    names = sorted(g for g, row in grams.items() if row.sum() >= 2)
    triple_rows = np.array([np.zeros(n), *(grams[g] for g in names)])  # row 0: a triple not seen
    return Model({words[i]: k for k, i in enumerate(keep)}, logs(table, 0.5)[keep] if keep else np.zeros((0, n), np.float32), {g: k + 1 for k, g in enumerate(names)}, logs(triple_rows, 0.5))


def fit(rows: Iterable[tuple[str, str]], rounds: int = FIT_ROUNDS) -> Model:
    """A model from (text, label) with wrong labels among them: fitted to the labels first, then to its own reading of each sentence."""
    sentences, given = [], []
    for text, label in rows:
        for _, _, words, whole in units(text):
            if whole:
                sentences.append(words)
                given.append(LANGS.index(label))
    model, labels = _model(sentences, given), np.array(given, np.int64)
    for _ in range(rounds):
        read = (model.score(sentences)[0] + 2.0 * np.eye(len(LANGS))[labels]).argmax(axis=1) if sentences else labels
        model = _model(sentences, read.tolist())
    scores, share = model.score(sentences)
    best = scores.argmax(axis=1)
    model.usual = np.array([np.median(share[best == k]) if (best == k).any() else 0.0 for k in range(len(LANGS))])
    return model


def labelled_sample(df: DataFrame, row_id: str, text: str, label: Column, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts of each language, whole, by the hash of id and text: the same ones at every size."""
    named = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), label.alias("label")).where(F.col("label").isin(*LANGS) & (F.length("text") > 100))
    many = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}  # at most six rows
    draw = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1_000_000))
    wanted = F.lit(0)
    for lang, n in many.items():
        wanted = F.when(F.col("label") == lang, min(1_000_000, math.ceil(1_300_000 * rows / n))).otherwise(wanted)
    drawn = named.withColumn("draw", draw).where(F.col("draw") < wanted).limit(2 * rows * len(LANGS)).collect()
    out: list[tuple[str, str]] = []
    for lang in LANGS:
        own = sorted((r["draw"], r["text"]) for r in drawn if r["label"] == lang)
        out += [(t, lang) for _, t in own[:rows]]
    return out


def priors(df: DataFrame, label: str, outer: str, inner: str) -> DataFrame:
    """Chance of each language by place of origin: outer, inner, prior ARRAY<DOUBLE>, n (rows).

    Grouped counts of the labels at three levels; each level is smoothed by the one above with ``PRIOR_WEIGHT`` counts. A place
    without labels has the chances of the level above.
    """
    tally = [F.count_if(F.col(label) == lang).alias(lang) for lang in LANGS]
    fine = df.groupBy(outer, inner).agg(*tally, F.count("*").alias("n"))
    mid = fine.groupBy(outer).agg(*[F.sum(x).alias(f"m_{x}") for x in LANGS])
    top = mid.agg(*[F.coalesce(F.sum(f"m_{x}"), F.lit(0)).alias(f"t_{x}") for x in LANGS])

    def level(prefix: str, above: Column | None) -> Column:
        own = F.array(*[F.col(f"{prefix}{x}").cast("double") for x in LANGS])
        n = sum((F.col(f"{prefix}{x}") for x in LANGS), F.lit(0.0))
        if above is None:
            return F.transform(own, lambda c: (c + 1) / (n + len(LANGS)))
        return F.zip_with(own, above, lambda c, p: (c + PRIOR_WEIGHT * p) / (n + PRIOR_WEIGHT))

    joined = fine.join(mid, outer).crossJoin(F.broadcast(top))  # one row
    return joined.withColumn("p0", level("t_", None)).withColumn("p1", level("m_", F.col("p0"))).withColumn("prior", level("", F.col("p1"))).select(outer, inner, "prior", "n")


def decode(scores: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language of each sentence and its chance, by forward and backward passes over the sentences of all texts at once.

    ``scores`` has the sentences of all texts one after the other, ``offsets`` where each text begins and the last ends, ``start`` the
    chances of each text's first sentence.
    """
    n, k = scores.shape
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, longest = offsets[:-1][order], int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # texts with more sentences than that
    move = np.full((k, k), CHANGE / (k - 1)) + np.eye(k) * (1 - CHANGE - CHANGE / (k - 1))
    lik = np.exp(np.maximum((scores - scores.max(axis=1, keepdims=True)) * SHARPNESS, -60)) if n else scores
    forward, post = np.empty((n, k)), np.empty((n, k))
    prev = start[order]
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        row = (prev[:m] if t == 0 else prev[:m] @ move) * lik[at]
        prev = row / row.sum(axis=1, keepdims=True)
        forward[at] = prev
    back = np.ones((len(order), k))
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        row = forward[at] * back[:m]
        post[at] = row / row.sum(axis=1, keepdims=True)
        nxt = (back[:m] * lik[at]) @ move
        back[:m] = nxt / nxt.sum(axis=1, keepdims=True)
    best = post.argmax(axis=1) if n else np.empty(0, np.int64)
    return best, post[np.arange(n), best]


def stretches(begin: list[int], end: list[int], whole: list[bool], lang: list[int], sure: list[float], share: list[float]) -> list[tuple[int, int, int, float, int, float]]:
    """Begin, end, language, chance, whole sentences and share of fitting words of each run of one language. Parts that are no sentence go with the run they are in."""
    out: list[list] = []
    for i, k in enumerate(lang):
        same = bool(out) and out[-1][2] == k
        if not whole[i]:
            if same:
                out[-1][1] = end[i]
        elif same:
            own = out[-1]
            own[1] = end[i]
            own[3] += sure[i]
            own[4] += 1
            own[5] += share[i]
        else:
            out.append([begin[i], end[i], k, sure[i], 1, share[i]])
    return [(a, b, k, s / n, n, x / n) for a, b, k, s, n, x in out]


SEGMENTS = "segments array<struct<begin:int,end:int,lang:string,confidence:double,sentences:int>>"


def identify(df: DataFrame, row_id: str, text: str, label: str, outer: str, inner: str, model: Model | None = None, markup: str | None = None, address: str | None = None) -> DataFrame:
    """Every text with its stretches: row_id, declared, segments (begin, end, lang, confidence, sentences).

    Evidence: the words of each sentence (a model fitted on a bounded sample of labelled rows, letter triples for unknown words),
    the label, the language that the markup declares (of the text itself, or of column ``markup``), the ending of column ``address`` if there
    is one, and the chances of the place of origin, smoothed from ``inner`` (a host or journal) over ``outer`` (a source) to all. All texts
    take the same way. A stretch whose words don't belong to its best language, as ``FOREIGN`` has it, gets the language ``other``.
    Quotations, titles before `` | ``, tags and asides are no evidence. Texts that are null, blank or without sentences have no
    segments; very long ones are read whole; repeated rows stay. What is shuffled is the scores, not the texts; places with many rows are
    split among tasks.
    """
    said = declared(F.col(label))
    model = model or fit(labelled_sample(df, row_id, text, said))
    held = df.sparkSession.sparkContext.broadcast(model)
    place = lambda c: F.coalesce(F.lower(squeeze(F.col(c))), F.lit(""))
    marked = declared(F.col(markup)) if markup else from_markup(F.col(text))
    ending = from_address(F.col(address)) if address else F.lit(None).cast("string")
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), said.alias("declared"), marked.alias("markup"), ending.alias("ending"), place(outer).alias("outer"), place(inner).alias("inner"))
    kind = dict(rows.dtypes)["row_id"]
    kept = ["row_id", "declared", "markup", "ending", "outer", "inner"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [units(t) if t else [] for t in batch.column("text").to_pylist()]
            flat = [u for f in found for u in f]
            scores, share = own.score([u[2] for u in flat])
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = lambda values, kind, by=1: pa.ListArray.from_arrays(pa.array(offsets * by, pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    lists([u[0] for u in flat], pa.int32()),
                    lists([u[1] for u in flat], pa.int32()),
                    lists([u[3] for u in flat], pa.bool_()),
                    lists(scores.astype(np.float32).ravel(), pa.float32(), len(LANGS)),
                    lists(share.astype(np.float32), pa.float32()),
                ],
                names=[*kept, "begins", "ends", "wholes", "scores", "shares"],
            )

    scored = spread(rows).mapInArrow(read, f"row_id {kind}, declared string, markup string, ending string, outer string, inner string, begins array<int>, ends array<int>, wholes array<boolean>, scores array<float>, shares array<float>")
    chances = priors(rows.select("declared", "outer", "inner"), "declared", "outer", "inner")
    fused = split_join(scored, chances.drop("n"), ["outer", "inner"], chances.select("outer", "inner", "n"), "left", ["row_id"])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, own = len(LANGS), held.value
        factors = {}
        for name, trust in (("declared", TRUST), ("markup", MARKUP_TRUST), ("ending", SUFFIX_TRUST)):
            factors[name] = {lang: np.where(np.arange(k) == i, trust, (1 - trust) / (k - 1)) for i, lang in enumerate(LANGS)}
        struct = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())])
        for batch in batches:
            column = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("begins", "ends", "wholes", "scores", "shares")}
            offsets = np.cumsum([0, *(batch.column("begins").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            start = np.array([p if p else [1 / k] * k for p in batch.column("prior").to_pylist()], np.float64).reshape(-1, k)
            for name, by in factors.items():
                for i, said in enumerate(batch.column(name).to_pylist()):
                    if said in by:
                        start[i] *= by[said]
            start /= start.sum(axis=1, keepdims=True) if len(start) else 1
            lang, sure = decode(column["scores"].astype(np.float64).reshape(-1, k), offsets, start)
            b, e, w, x = (column[c].tolist() for c in ("begins", "ends", "wholes", "shares"))
            lang, sure = lang.tolist(), sure.tolist()
            out, ends = [], [0]
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if j > i:
                    out += stretches(b[i:j], e[i:j], w[i:j], lang[i:j], sure[i:j], x[i:j])
                ends.append(len(out))
            named = [LANGS[r[2]] if r[5] >= FOREIGN * own.usual[r[2]] else "other" for r in out]
            fields = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array(named, pa.string()), pa.array([r[3] for r in out], pa.float64()), pa.array([r[4] for r in out], pa.int32())]
            segments = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(struct)))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("declared"), segments], names=["row_id", "declared", "segments"])

    return fused.select("row_id", "declared", "markup", "ending", "begins", "ends", "wholes", "scores", "shares", "prior").mapInArrow(fuse, f"row_id {kind}, declared string, {SEGMENTS}")


def languages(found: DataFrame) -> DataFrame:
    """Languages in each text, with at least ``IN_A_ROW`` whole sentences in a row: row_id, declared, langs, confidence by language."""
    own = F.filter("segments", lambda s: (s["sentences"] >= IN_A_ROW) & (s["lang"] != "other"))
    return found.select("row_id", "declared", "segments", F.array_sort(F.array_distinct(F.transform(own, lambda s: s["lang"]))).alias("langs"))


def mislabelled(found: DataFrame) -> DataFrame:
    """One row for each language of the texts whose label is missing or wrong, or which have several: row_id, true_lang, confidence."""
    langs = languages(found)
    wrong = (F.size("langs") > 1) | ((F.size("langs") == 1) & ~F.coalesce(F.col("declared") == F.col("langs")[0], F.lit(False)))
    rows = langs.where(wrong).select("row_id", "segments", F.explode("langs").alias("true_lang"))
    own = F.filter("segments", lambda s: s["lang"] == F.col("true_lang"))
    weight = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["confidence"] * s["sentences"])
    count = F.aggregate(own, F.lit(0), lambda a, s: a + s["sentences"])
    return rows.select("row_id", "true_lang", F.round(weight / count, 4).alias("confidence"))

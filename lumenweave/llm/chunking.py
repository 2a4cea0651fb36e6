"""Oversized token records cut into pieces with a fixed overlap."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import SPACES

LIMIT, OVERLAP = 512, 128
INSIDE, PLAIN, CLAUSE, SENTENCE = 9, 1, 2, 3
ENDS, CLAUSE_ENDS, CLOSERS = frozenset(".!?…。"), frozenset(",;:"), frozenset("\"')]}”’»")


def real(tokens: Column) -> Column:
    """Tokens that are neither null nor white space only."""
    return F.filter(tokens, lambda t: t.isNotNull() & (F.btrim(t, F.lit(SPACES)) != ""))


@lru_cache(maxsize=10_000)
def entity_of(tag: str | None) -> tuple[str, str]:
    """Prefix (B, I or O) and type of a tag, however it is written; of alternatives joined by ``|`` the first counts."""
    t = (tag or "O").split("|")[0].strip().upper()
    head, _, kind = t.partition("-")
    return (head, kind) if head in ("B", "I") and kind else ("O", "")


def strengths(tokens: list[str], tags: list[str]) -> list[int]:
    """How strong the boundary after each token but the last is; ``INSIDE`` where an entity goes on."""
    out, ended = [], False
    marks = [entity_of(t) for t in tags]
    for i in range(len(tokens) - 1):
        t = tokens[i]
        ended = t in ENDS or (ended and t in CLOSERS)
        if marks[i + 1][0] == "I" and marks[i][0] != "O" and marks[i][1] == marks[i + 1][1]:
            out.append(INSIDE)
        elif ended:
            out.append(PLAIN if tokens[i + 1] in CLOSERS else SENTENCE)
        else:
            out.append(CLAUSE if t in CLAUSE_ENDS else PLAIN)
    return out


def segments(bounds: list[int], n: int, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``n`` tokens: agglomerative merging of the weakest boundaries.

    Atoms are runs that no boundary but ``INSIDE`` and ``PLAIN`` parts, if a piece can add them whole (all their pairs would be merged before
    any other), else runs that ``INSIDE`` parts. A heap holds adjacent pairs by strength, combined size and place; the weakest are merged
    while the combined size and the overlap from the piece before fit into ``limit``. The first piece has no overlap before it, but has at
    least ``overlap`` tokens, so that the next can share as many. An entity longer than what a piece adds, ``limit - overlap``, is cut
    there, as nothing else can be done.
    """
    room = limit - overlap
    first = _first_end(bounds, n, limit, overlap)
    atoms: list[tuple[int, int]] = [(0, first)]
    run = first
    for stop in [*(i + 1 for i in range(first, n - 1) if bounds[i] in (CLAUSE, SENTENCE)), n]:
        if 0 < stop - run <= room:
            atoms.append((run, stop))
        else:
            begin = run
            for i in range(run, stop):
                if i == stop - 1 or bounds[i] != INSIDE or i + 1 - begin >= room:
                    atoms.append((begin, i + 1))
                    begin = i + 1
        run = stop
    start = [a for a, _ in atoms]
    end = [b for _, b in atoms]
    left, right = list(range(-1, len(atoms) - 1)), [*range(1, len(atoms)), -1]
    alive, stamp = [True] * len(atoms), [0] * len(atoms)
    heap: list[tuple[int, int, int, int, int, int, int]] = []

    def push(a: int, b: int) -> None:
        if a < 0 or b < 0:
            return
        size = end[b] - start[a]
        if size <= (limit if start[a] == 0 else room):
            heapq.heappush(heap, (bounds[end[a] - 1], size, start[a], a, b, stamp[a], stamp[b]))

    for k in range(len(atoms) - 1):
        push(k, k + 1)
    while heap:
        _, _, _, a, b, x, y = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or stamp[a] != x or stamp[b] != y:
            continue
        end[a] = end[b]
        alive[b] = False
        stamp[a] += 1
        right[a] = right[b]
        if right[a] >= 0:
            left[right[a]] = a
        push(left[a], a)
        push(a, right[a])
    return [end[k] for k in range(len(atoms)) if alive[k]]


def _first_end(bounds: list[int], n: int, limit: int, overlap: int) -> int:
    """End of the first atom: the first sentence end at ``overlap`` tokens or later, else the first other fit place."""
    least = min(max(overlap, 1), n)
    for want in (SENTENCE, CLAUSE, PLAIN):
        for i in range(least - 1, min(limit, n)):
            if i == n - 1 or (bounds[i] >= want and bounds[i] != INSIDE):
                return i + 1
    return min(limit, n)


def pieces(tokens: list[str], tags: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans [a, b) of the pieces; one span where the tokens fit."""
    n = len(tokens)
    if n <= limit:
        return [(0, n)]
    ends = segments(strengths(tokens, tags), n, limit, overlap)
    return [(0 if k == 0 else ends[k - 1] - overlap, b) for k, b in enumerate(ends)]


def split_oversized(df: DataFrame, row_id: str, tokens: str, tags: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the records with more than ``limit`` tokens: rec_id, piece (from 1), begin, n_tokens, tokens, ner_tags.

    Null and white-space-only tokens don't count and are left out with their tags; missing tags (null list, short list, null
    element) are ``O``, surplus ones are dropped. Each piece has at most ``limit`` tokens and begins with the last ``overlap``
    tokens of the one before; it ends at a sentence end if one is in reach and never inside an entity. Records within the
    limit, null and empty ones give no row. Records don't meet, so there is no shuffle; repeated rows keep their own pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    rows = df.where(F.size(tokens) > limit).select(F.col(row_id).cast("bigint").alias("rec_id"), F.col(tokens).alias("t"), F.col(tags).alias("g")).where(F.size(real(F.col("t"))) > limit)
    # Longer of the two lists sets the length of the zip; tokens beyond the token list are null and go.
    both = F.filter(F.arrays_zip("t", F.coalesce("g", F.array().cast("array<string>")).alias("g")), lambda x: x["t"].isNotNull() & (F.btrim(x["t"], F.lit(SPACES)) != ""))
    clean = rows.select("rec_id", both.alias("z")).select("rec_id", F.col("z.t").alias("t"), F.transform("z", lambda x: F.coalesce(x["g"], F.lit("O"))).alias("g"))

    @F.arrow_udf("array<struct<begin:int,n:int>>")
    def cut(words: pa.Array, marks: pa.Array) -> pa.Array:
        spans = [pieces(w, m, limit, overlap) for w, m in zip(words.to_pylist(), marks.to_pylist())]
        flat = np.array([(a, b - a) for own in spans for a, b in own], np.int32).reshape(-1, 2)
        offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["begin", "n"]))

    out = clean.select("rec_id", "t", "g", F.posexplode(cut("t", "g")).alias("at", "s"))
    part = lambda c: F.slice(c, F.col("s.begin") + 1, F.col("s.n"))
    return out.select("rec_id", (F.col("at") + 1).alias("piece"), "s.begin", F.col("s.n").alias("n_tokens"), part("t").alias("tokens"), part("g").alias("ner_tags"))

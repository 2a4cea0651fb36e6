"""The same or nearly the same records across splits: an exact bipartite join on rare shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import SPACE
from lumenweave.operators.skew import split_join
from lumenweave.session import remove, stored, tidy, written

#: Words in a shingle; records of nine words, where two of five don't fit, take four.
Q, SHORT_Q, SHORT_N = 5, 4, 9
#: One edit in that many words of the longer record is allowed.
PER_EDIT = 10
#: Size of the table that orders shingles by rarity, by the words of training, and of the one that says which shingles the index has, by its
#: rows, within these bounds. Both are sent to every worker and only steer; beyond the upper bound more rows are probed in vain, but none is
#: lost.
DF_BITS, SEEN_BITS = (14, 21), (16, 27)
#: Shingles are joined in passes, each over one range of their hashes, so that little of the index is on disk at a time: one pass for so many
#: words of training, and at most so many passes.
PASS_WORDS, MOST_PASSES = 1 << 20, 16
#: Lengths from which a new class of lengths begins; classes only steer.
EDGES = np.unique(np.array([1.5**k for k in range(54)], np.int64))
#: Counters of the words of a record, by their hashes, each modulo 256.
COUNTERS = 256

_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(tokens: Column) -> Column:
    """Runs of letters and digits in the lower-cased tokens, in order."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", tokens)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


@cache
def most_edits(n: int) -> int:
    """Most edits between a record of ``n`` words and any partner within the limit."""
    m = n
    while (m + 1) - n <= (m + 1) // PER_EDIT:
        m += 1
    return m // PER_EDIT


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of two sequences, or most + 1 if it is larger: bit-parallel, with Python's long integers."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    lo, hi_a, hi_b = 0, len(a), len(b)
    same = np.flatnonzero(a[:hi_a] != b[:hi_a])
    lo = int(same[0]) if len(same) else hi_a
    tail = min(hi_a, hi_b) - lo
    if tail:
        diff = np.flatnonzero(a[hi_a - tail : hi_a][::-1] != b[hi_b - tail : hi_b][::-1])
        cut = int(diff[0]) if len(diff) else tail
        hi_a, hi_b = hi_a - cut, hi_b - cut
    a, b = a[lo:hi_a], b[lo:hi_b]
    m = len(a)
    if m == 0:
        return len(b) if len(b) <= most else most + 1
    peq: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        peq[w] = peq.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = full, 0, m, len(b)
    for w in b.tolist():
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        left -= 1
        if score - left > most:
            return most + 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return score if score <= most else most + 1


def _shingles(flat: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of ``q`` words in the flat array, runs over record ends included."""
    w = flat.astype(np.int64).view(np.uint64)
    n = max(0, len(w) - q + 1)
    h = np.full(n, np.uint64(q), np.uint64)
    for k in range(q):
        h = (h ^ w[k : k + n]) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _places(offsets: np.ndarray, q: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every shingle that lies within one record: its record, its place there, its place in the flat array."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - q + 1, 0)
    if keep is not None:
        counts = np.where(keep, counts, 0)
    record = np.repeat(np.arange(len(sizes)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    return record, place, offsets[:-1][record] + place


def _sides(df: DataFrame, row_id: str, split: str, tokens: str, extra: list[Column]) -> DataFrame:
    """Records of train, dev and test with words: rec_id, split, train, text_key, ws (hashes of the words) and the extra columns."""
    name = F.lower(F.trim(F.regexp_replace(F.col(split), f"{SPACE}+", " ")))
    rows = df.select(F.col(row_id).cast("bigint").alias("rec_id"), name.alias("split"), F.col(tokens).alias("tokens"), *extra).where(F.col("split").isin("train", "dev", "test"))
    said = rows.withColumn("words", words(F.col("tokens"))).drop("tokens").where(F.size("words") > 0)
    return said.select("*", (F.col("split") == "train").alias("train"), F.unhex(F.md5(F.array_join("words", " "))).alias("text_key"), F.transform("words", lambda w: F.xxhash64(w)).alias("ws")).drop("words")


def prefix(own: np.ndarray, rank: np.ndarray, k: int, q: int) -> np.ndarray:
    """Places of a record's rarest shingles: so many, in the order of rank and hash, that ``k`` of them don't overlap.

    With ``k`` one more than the edits, no edits within the limit change them all, so a partner has one of them. The last hash is taken with
    all its places. A record that has no such prefix gives all its shingles.
    """
    order = np.lexsort((own, rank))
    taken = bytearray(len(own) + q - 1)
    for at, i in enumerate(order.tolist()):
        if not (taken[i] or taken[i + q - 1]):
            taken[i : i + q] = b"\1" * q
            k -= 1
            if not k:
                last = own[i]
                while at + 1 < len(order) and own[order[at + 1]] == last:
                    at += 1
                return order[: at + 1]
    return order


def _bits(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """256 bits in four words that say which words a record has; one edit changes at most two of them."""
    w = flat.view(np.uint64)
    one = np.uint64(1) << (w & np.uint64(63))
    part = (w >> np.uint64(6)) & np.uint64(3)
    zero = np.zeros(1, np.uint64)
    return [np.bitwise_or.reduceat(np.concatenate([np.where(part == k, one, np.uint64(0)), zero]), offsets[:-1]).view(np.int64) for k in range(4)]


CLASS = "train boolean, text_key binary, rep bigint, ws array<bigint>, marks binary, short binary, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
PREFIX = "k bigint, rep bigint, n int, pos int"


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Least edits that the words of two sequences allow, wherever they stand."""
    _, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(where)), np.bincount(where[len(a) :], minlength=len(where))
    return max(len(a), len(b)) - int(np.minimum(x, y).sum())


def _hit(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap has, or seems to have."""
    top = h.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)


def _those(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows whose hash in column ``key`` the bitmap has, or seems to have, without that column."""
    for batch in batches:
        yield batch.filter(pa.array(_hit(bitmap, bits, batch.column("key").to_numpy(zero_copy_only=False)))).drop_columns(["key"])


def _described(batches: Iterator[pa.RecordBatch], rarity: np.ndarray, copied: tuple[np.ndarray, int] | None = None) -> Iterator[pa.RecordBatch]:
    """Classes with their word bits and with the places of their prefixes, a bit each: of shingles in ``marks``, of those of four words in
    ``short``. Evaluation keeps what training has. With ``copied``, rows whose hash (key) that bitmap has are left out."""
    mask = np.uint64(len(rarity) - 1)
    for batch in batches:
        if copied:
            batch = batch.filter(pa.array(~_hit(*copied, batch.column("key").to_numpy(zero_copy_only=False))))
        if not batch.num_rows:
            continue
        flat, offsets = _lists(batch.column("ws"))
        sizes, train = np.diff(offsets), batch.column("train").to_numpy(zero_copy_only=False)
        marks = []
        for q, fit in ((Q, sizes > SHORT_N), (SHORT_Q, (sizes == SHORT_N) | (sizes == SHORT_N + 1))):
            out = [b""] * batch.num_rows
            every = _shingles(flat, q) if fit.any() else flat
            for i in np.flatnonzero(fit).tolist():
                own = every[offsets[i] : offsets[i + 1] - q + 1]
                count = rarity[(own & mask).astype(np.int64)]
                got = prefix(own, count, most_edits(int(sizes[i])) + 1, q)
                own_marks = np.zeros(len(own), bool)
                own_marks[got if train[i] else got[count[got] > 0]] = True  # a shingle that training has not meets none
                out[i] = np.packbits(own_marks).tobytes()
            marks.append(pa.array(out, pa.binary()))
        rest = [batch.column("train"), batch.column("text_key"), batch.column("rep"), batch.column("ws"), *marks, *map(pa.array, _bits(flat, offsets))]
        yield pa.RecordBatch.from_arrays(rest, names=["train", "text_key", "rep", "ws", "marks", "short", "b0", "b1", "b2", "b3"])


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every shingle of the prefixes: its record, its place there, its hash; and the sizes of the records."""
    flat, offsets = _lists(batch.column("ws"))
    rec, place, h = [], [], []
    for q, name in ((Q, "marks"), (SHORT_Q, "short")):
        marks = batch.column(name).cast(pa.binary())
        begin = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1].astype(np.int64)
        if begin[-1] == begin[0]:
            continue
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(marks.buffers()[2], np.uint8)[begin[0] : begin[-1]]))
        begin = 8 * (begin - begin[0])
        own = np.repeat(np.arange(len(marks)), np.diff(np.searchsorted(bits, begin)))
        rec.append(own)
        place.append(bits - begin[own])
        h.append(_shingles(flat, q)[offsets[own] + place[-1]])
    rec, place, h = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rec, place, h))
    return rec, place, h.astype(np.uint64), np.diff(offsets)


def _key(h: np.ndarray, length: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Hash of a shingle, a class of lengths and a cell of places."""
    k = (h ^ (length.astype(np.uint64) << np.uint64(40) ^ cell.astype(np.uint64)) * _MULT) * _MULT
    return k ^ k >> np.uint64(29)


def _cells(length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Cells of places, each four times as wide as the most edits in its class of lengths."""
    return place // (4 * (1 + EDGES[np.minimum(length, len(EDGES) - 1)] // (PER_EDIT - 1)))


def _prefix_rows(batches: Iterator[pa.RecordBatch], at: int, passes: int, seen: tuple[np.ndarray, int] | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the prefixes whose hash, mixed again, is in the range of pass ``at``, by shingle, class of lengths and cell of places.

    Training (with ``seen``) has its own class and cell only, and leaves out what the index has not. Evaluation has every class and cell
    that a partner may be in, so that partners meet once for each shared shingle.
    """
    for batch in batches:
        rec, place, h, sizes = _prefixes(batch)
        mixed = h * _MULT  # prefixes prefer low hashes
        mine = np.flatnonzero((mixed >> np.uint64(32)) * np.uint64(passes) >> np.uint64(32) == at)
        rec, place, h = rec[mine], place[mine], h[mine]
        n, each = sizes[rec], []
        if seen:
            length = np.searchsorted(EDGES, n, "right")
            k = _key(h, length, _cells(length, place))
            hit = np.flatnonzero(_hit(*seen, k))
            each.append((k[hit], hit))
        else:
            most = n // (PER_EDIT - 1)  # no partner is farther
            low, high = np.searchsorted(EDGES, n - n // PER_EDIT, "right"), np.searchsorted(EDGES, n + most, "right")
            for more in range(int((high - low).max(initial=0)) + 1):
                some = np.flatnonzero(low + more <= high)
                length = low[some] + more
                first, last = _cells(length, np.maximum(0, place[some] - most[some])), _cells(length, place[some] + most[some])
                for further in range(int((last - first).max(initial=0)) + 1):
                    there = np.flatnonzero(first + further <= last)
                    each.append((_key(h[some[there]], length[there], first[there] + further), some[there]))
        rep = batch.column("rep").to_numpy(zero_copy_only=False)
        for k, where in each:
            columns = [k.view(np.int64), rep[rec[where]].astype(np.int64), n[where].astype(np.int32), place[where].astype(np.int32)]
            for a in range(0, len(where), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=["k", "rep", "n", "pos"])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class: train, rep, its number of words and its counters."""
    for batch in batches:
        flat, offsets = _lists(batch.column("ws"))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        at = rows * COUNTERS + (flat.view(np.uint64) >> np.uint64(40)).astype(np.int64) % COUNTERS
        data = np.bincount(at, minlength=batch.num_rows * COUNTERS).astype(np.uint8).tobytes()
        counters = pa.array([data[a : a + COUNTERS] for a in range(0, len(data), COUNTERS)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("train"), batch.column("rep"), pa.array(np.diff(offsets).astype(np.int32)), counters], names=["train", "rep", "n", "c"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counters allow that they are within the limit: an edit takes one from a counter, adds one to a counter, or both."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COUNTERS) for c in ("e_c", "t_c"))
        n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("e_n", "t_n"))
        apart = np.abs((a - b).view(np.int8).astype(np.int64)).sum(1) + np.abs(n - m)
        yield batch.select(["e_rep", "t_rep"]).filter(pa.array(apart <= 2 * (np.maximum(n, m) // PER_EDIT)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the limit, with their edits."""
    for batch in batches:
        (a, ao), (b, bo) = _lists(batch.column("e_ws")), _lists(batch.column("t_ws"))
        edits = np.zeros(batch.num_rows, np.int32)
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = a[ao[i] : ao[i + 1]], b[bo[i] : bo[i + 1]]
            most = max(len(x), len(y)) // PER_EDIT
            edits[i] = most + 1 if bag_distance(x, y) > most else distance_within(x, y, most)
            good[i] = 0 < edits[i] <= most
        index = pa.array(np.flatnonzero(good), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("e_rep").take(index), batch.column("t_rep").take(index), pa.array(edits[good], pa.int32())], names=["e_rep", "t_rep", "edits"])


def _table(rows: DataFrame, bits: int) -> np.ndarray:
    """A table of at most 2 ** ``bits`` numbers, from rows (at, n): what is collected doesn't grow beyond that."""
    out = np.zeros(1 << bits, np.int64)
    got = rows.toArrow()
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _bitmap(hashes: DataFrame) -> tuple[Broadcast, int]:
    """Which hashes (k) there are, by their leading bits, for ``_hit``, and the number of bits."""
    bits = min(SEEN_BITS[1], max(SEEN_BITS[0], (16 * hashes.count()).bit_length()))
    at = F.call_function("shiftrightunsigned", F.col("k"), F.lit(64 - bits))
    word = hashes.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    table = _table(word.groupBy("at").agg(F.bit_or("bit").alias("n")), bits - 6).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table), bits


def _rarity(train: DataFrame, many: int) -> Broadcast:
    """Counts of the shingles of training (ws), by the last bits of their hashes: the order of all prefixes."""
    df_bits = min(DF_BITS[1], max(DF_BITS[0], int(many).bit_length()))
    mask = np.uint64((1 << df_bits) - 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << df_bits, np.int64)
        for batch in batches:
            flat, offsets = _lists(batch.column("ws"))
            short = (np.diff(offsets) == SHORT_N) | (np.diff(offsets) == SHORT_N + 1)
            for q, keep in ((Q, None), (SHORT_Q, short)):
                if keep is None or keep.any():
                    _, _, where = _places(offsets, q, keep)
                    total += np.bincount((_shingles(flat, q)[where] & mask).astype(np.int64), minlength=1 << df_bits)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 50_000):
            part = some[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["at", "n"])

    counts = train.select("ws").mapInArrow(tally, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    return train.sparkSession.sparkContext.broadcast(_table(counts, df_bits).astype(np.int32))


def _some(kept: DataFrame, pairs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The classes (train, rep, ws) that the pairs have, and few others, without a shuffle; and what is to be destroyed afterwards."""
    ends = pairs.select(F.xxhash64(F.lit(False), "e_rep").alias("k")).union(pairs.select(F.xxhash64(F.lit(True), "t_rep")))
    has, bits = _bitmap(ends)
    rows = kept.select("train", "rep", "ws", F.xxhash64("train", "rep").alias("key"))
    return rows.mapInArrow(lambda bs: _those(bs, has.value, bits), "train boolean, rep bigint, ws array<bigint>"), has


def _both(pairs: DataFrame, ends: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with these columns of either end besides, as e_ and t_."""
    for side, flag in (("e", "not train"), ("t", "train")):
        pairs = pairs.join(ends.where(flag).select(F.col("rep").alias(f"{side}_rep"), *(F.col(c).alias(f"{side}_{c}") for c in columns)), f"{side}_rep")
    return pairs


def near_classes(kept: DataFrame, words_of_training: int) -> DataFrame:
    """Pairs of classes of either side, of different text, within the limit: e_rep, t_rep, edits.

    A prefix filter: all shingles have one order, by their count in training and then their hash. The prefix of a record is its rarest
    shingles up to the first that makes one more of them disjoint than there can be edits (the shortest prefix that so many edits may not
    change altogether). Of two records within the limit, that with the lesser last shingle has one in common with the other, which then
    is in the other's prefix too. Index: the prefixes of evaluation classes. Probe: those of training classes. They meet by shingle, class
    of lengths and cell of places; length, place (the words before and after the shared shingle) and word bits filter what met, then
    counters of words, and what is left is verified by the exact distance. A shingle that many share is split among tasks. No link is lost.

    Each pass has a range of the hashes. Its index, probes and shuffles are removed before the next one begins.
    """
    spark = kept.sparkSession
    passes = min(MOST_PASSES, max(1, words_of_training // PASS_WORDS))
    rows = kept.select("train", "rep", "ws", "marks", "short")
    bits = [f"b{k}" for k in range(4)]
    found = []
    with tidy(spark):
        for p in range(passes):
            indexed, index_path = stored(rows.where("not train").mapInArrow(lambda bs, p=p: _prefix_rows(bs, p, passes), PREFIX), "overlap-index")
            seen, seen_bits = _bitmap(indexed)
            probing, probe_path = stored(rows.where("train").mapInArrow(lambda bs, p=p, seen=seen, b=seen_bits: _prefix_rows(bs, p, passes, (seen.value, b)), PREFIX), "overlap-probes")
            seen.destroy()
            t = probing.withColumnsRenamed({c: f"t_{c}" for c in probing.columns if c != "k"})
            e = indexed.withColumnsRenamed({c: f"e_{c}" for c in indexed.columns if c != "k"})
            met = split_join(t, e, ["k"], probing.groupBy("k").agg(F.count("*").alias("n")))
            allowed = F.floor(F.greatest("e_n", "t_n") / PER_EDIT)
            before, after = F.abs(F.col("e_pos") - F.col("t_pos")), F.abs((F.col("e_n") - F.col("e_pos")) - (F.col("t_n") - F.col("t_pos")))
            near = met.where((F.abs(F.col("e_n") - F.col("t_n")) <= allowed) & (before + after <= allowed)).select("e_rep", "t_rep", allowed.alias("allowed")).distinct()
            apart = sum((F.bit_count(F.col(f"e_{b}").bitwiseXOR(F.col(f"t_{b}"))) for b in bits), F.lit(0))
            alike = _both(near, kept, bits).where(apart <= 2 * F.col("allowed"))
            found.append(stored(alike.select("e_rep", "t_rep"), "overlap-candidates")[1])
            remove(spark, index_path)
            remove(spark, probe_path)
        candidates, candidates_path = stored(spark.read.schema("e_rep bigint, t_rep bigint").parquet(*found).distinct(), "overlap-candidates")
        for path in found:
            remove(spark, path)
        some, has = _some(kept, candidates)
        counted = some.mapInArrow(_counters, "train boolean, rep bigint, n int, c binary")
        close, close_path = stored(_both(candidates, counted, ["n", "c"]).mapInArrow(_close, "e_rep bigint, t_rep bigint"), "overlap-close")
        has.destroy()
        some, has = _some(kept, close)
        near = stored(_both(close, some, ["ws"]).mapInArrow(_verified, "e_rep bigint, t_rep bigint, edits int"), "overlap-near")[0]
        has.destroy()
        remove(spark, candidates_path)
        remove(spark, close_path)
    return near


class SplitOverlap:
    """Overlaps between the train split and the dev and test splits of token records.

    Split names count apart from case and surrounding blanks; records of no split, or without words (null, empty or only
    punctuation), take no part. Tags don't matter. Exact copies are one class: ``links`` has pairs of classes, ``membership`` each record
    with its class and its number of links, and ``pairs`` the pairs of records.
    """

    def __init__(self, df: DataFrame, row_id: str, split: str, tokens: str, source: str | None = None):
        extra = [F.col(source).alias("source")] if source else [F.lit(None).cast("string").alias("source")]
        spark = df.sparkSession
        with tidy(spark):
            records, path = stored(_sides(df, row_id, split, tokens, extra), "overlap-records")
            self.members = stored(records.select("rec_id", "split", "source", "train", "text_key"), "overlap-members")[0]
            train = records.where("train")
            self.words_of_training = int(train.agg(F.coalesce(F.sum(F.size("ws")), F.lit(1)).alias("n")).first()["n"])
            rarity = _rarity(train, self.words_of_training)
            # Texts of one record go on as they are; only those that seem to be copied are shuffled with their words.
            key = ["train", "text_key"]
            reps, reps_path = stored(self.members.groupBy(*key).agg(F.min("rec_id").alias("rep"), F.count("*").alias("n")), "overlap-reps")
            copied, bits = _bitmap(reps.where("n > 1").select(F.xxhash64(*key).alias("k")))
            rows = records.select(*key, F.col("rec_id").alias("rep"), "ws", F.xxhash64(*key).alias("key"))
            lone = rows.mapInArrow(lambda bs: _described(bs, rarity.value, (copied.value, bits)), CLASS)
            more = rows.mapInArrow(lambda bs: _those(bs, copied.value, bits), "train boolean, text_key binary, rep bigint, ws array<bigint>")
            # Where ids repeat, a class may have its least id in several rows, of which one is drawn.
            first = more.join(reps, [*key, "rep"], "left_semi").groupBy(*key, "rep").agg(F.any_value("ws").alias("ws"))
            self.kept = stored(lone.union(first.mapInArrow(lambda bs: _described(bs, rarity.value), CLASS)), "overlap-classes")[0]
            copied.destroy()
            rarity.destroy()
            remove(spark, reps_path)
            remove(spark, path)

    def links(self) -> DataFrame:
        """Pairs of classes: e_key, t_key, edits (0: the same words)."""
        keys = self.kept.select("rep", "text_key", "train")
        held, train = keys.where("not train").drop("train"), keys.where("train").drop("train")
        near = near_classes(self.kept, self.words_of_training).join(held.withColumnsRenamed({"rep": "e_rep", "text_key": "e_key"}), "e_rep").join(train.withColumnsRenamed({"rep": "t_rep", "text_key": "t_key"}), "t_rep")
        same = held.join(train.select("text_key"), "text_key").select(F.col("text_key").alias("e_key"), F.col("text_key").alias("t_key"), F.lit(0).alias("edits"))
        return near.select("e_key", "t_key", "edits").union(same)

    def pairs(self) -> DataFrame:
        """Pairs of records: rec_id_a < rec_id_b, edits."""
        e = self.members.where("not train").select(F.col("rec_id").alias("e"), F.col("text_key").alias("e_key"))
        t = self.members.where("train").select(F.col("rec_id").alias("t"), F.col("text_key").alias("t_key"))
        full = written(self.links(), "overlap-links").join(e, "e_key").join(t, "t_key")
        return full.select(F.least("e", "t").alias("rec_id_a"), F.greatest("e", "t").alias("rec_id_b"), "edits")

    def membership(self) -> DataFrame:
        """One row for each record: rec_id, split, source, class_id (the least id of its class on its side), links (classes of the other side)."""
        links = written(self.links(), "overlap-links")
        ends = links.select(F.col("e_key").alias("text_key"), F.lit(False).alias("train")).union(links.select("t_key", F.lit(True)))
        counted = ends.groupBy("train", "text_key").agg(F.count("*").alias("links"))
        own = self.kept.select("train", "text_key", F.col("rep").alias("class_id")).join(counted, ["train", "text_key"], "left")
        sizes = self.members.groupBy("train", "text_key").agg(F.count("*").alias("n"))
        full = split_join(self.members, own, ["train", "text_key"], sizes, "left")
        return full.select("rec_id", "split", "source", "class_id", F.coalesce("links", F.lit(0)).alias("links"))

    def report(self) -> DataFrame:
        """Per split and source: records, and how many have the same or nearly the same words as a training record."""
        best = self.links().groupBy(F.col("e_key").alias("text_key")).agg(F.min("edits").alias("edits"))
        held = self.members.where("not train").join(best, "text_key", "left")
        return held.groupBy("split", "source").agg(F.count("*").alias("records"), F.count_if(F.col("edits").isNotNull()).alias("overlapping"), F.count_if(F.col("edits") == 0).alias("same"))

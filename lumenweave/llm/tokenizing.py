"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import spread, width

#: Folder of the vocabulary files.
HOME = "/opt/tokenizers"
#: Fixed value: the pattern that parts a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond which a text is encoded in parts; bytes beyond which an unsplit run is halved.
LEAF = 1 << 15
TEXT, RUN, MORE = 0, 1, 2
# Letters and signs of several scripts, none of them new to the standard, so that every tool knows their class.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-Ωα-ωА-яא-תء-غف-يぁ-ゖァ-ヺ㐀-䶵一-鿌가-힣"
_SIGNS = r"!-&(-/:-@\[-`{-~、。〈〉《》「」『』【】！＂（），－．：；？［］｛｝。，、؛؟،…–—“”«»·¡¿"
#: Where the pattern parts any text: after a visible character before a blank, and between letters, digits and signs other than the apostrophe.
SAFE = re.compile(rf"(?<=[{_LETTERS}0-9{_SIGNS}])(?=[ \n])|(?<=[{_LETTERS}])(?=[0-9{_SIGNS}])|(?<=[0-9])(?=[{_LETTERS}{_SIGNS}])|(?<=[{_SIGNS}])(?=[{_LETTERS}0-9])")
#: Runs of one class of characters.
ONE_CLASS = regex.compile(r"\p{L}+|\p{N}+|\p{White_Space}+|[^\p{White_Space}\p{L}\p{N}]+")
BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))

_BUILT: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Ids of a text by a byte-level vocabulary of merge ranks, without special tokens; their names are ordinary text.

    Null and empty texts have no ids: an empty list.
    """

    def __init__(self, name: str, home: str = HOME):
        import tiktoken

        with open(os.path.join(home, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        return self.core.encode_ordinary(text) if text else []

    def run(self, piece: bytes) -> list[int]:
        """Ids of an unsplit run."""
        return self.core._encode_single_piece(piece)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.core.decode_single_token_bytes, ids))

    def leaves(self, text: str, leaf: int = LEAF) -> Iterator[tuple[int, bytes]]:
        """Parts of a long text as (kind, bytes), each of which can be encoded alone.

        A ``TEXT`` part ends where the pattern parts any text, whatever stands around it. An unsplit run longer than ``leaf`` bytes
        comes as ``RUN`` and, from its second part on, ``MORE``. Where no place is known to be safe the part is longer.
        """
        begin, n = 0, len(text)
        while n - begin > leaf:
            m = SAFE.search(text, begin + leaf, min(n, begin + 2 * leaf))
            if m:
                yield TEXT, text[begin : m.start()].encode()
                begin = m.start()
                continue
            a, b = begin, n
            for run in ONE_CLASS.finditer(text, begin):
                a, b = run.span()
                if b > begin + leaf:
                    break
            blank = text[a] in BLANKS
            if not blank and a > begin and text[a - 1] == " ":
                a -= 1
            if blank and b < n:
                b -= 1
            head = text[begin:a]
            if b - a <= leaf // 2 or (a and text[a - 1] == "'") or (head and head[-1] in BLANKS and not blank):
                m = SAFE.search(text, begin + leaf)
                end = m.start() if m else n
                yield TEXT, text[begin:end].encode()
                begin = end
                continue
            if head:
                yield TEXT, head.encode()
            data = text[a:b].encode()
            for k, (x, y) in enumerate(_halves(0, len(data), leaf)):
                yield (MORE if k else RUN), data[x:y]
            begin = b
        if begin < n:
            yield TEXT, text[begin:].encode()

    def leaf_ids(self, part: bytes, kind: int) -> list[int]:
        return self.ids(part.decode()) if kind == TEXT else self.run(part)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of an unsplit run from those of its halves.

        A window around the join is encoded anew and grows until its first and last id agree with what the halves have there.
        A list of ids is what the merges give if each pair of neighbours is; with agreement at both ends every pair is.
        """
        k = 8
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.run(self.bytes_of(left[i:]) + self.bytes_of(right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins the parts of an unsplit run pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


def _halves(a: int, b: int, leaf: int) -> list[tuple[int, int]]:
    if b - a <= leaf:
        return [(a, b)]
    mid = (a + b) // 2
    return _halves(a, mid, leaf) + _halves(mid, b, leaf)


def encoder(name: str, home: str = HOME) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (name, home) not in _BUILT:
        _BUILT[name, home] = Encoder(name, home)
    return _BUILT[name, home]


def encode(df: DataFrame, row_id: str, text: str, name: str = "byte_bpe_50k", home: str = HOME, leaf: int = LEAF, counts: bool = False) -> DataFrame:
    """row_id and ids (ARRAY<INT>) of every text; with ``counts`` row_id and n_tokens instead.

    Null and empty texts have an empty list; blank texts are encoded as they are. Repeated rows and row ids keep a row each.
    Texts up to ``leaf`` characters are encoded where they are read, without a shuffle. Longer ones are cut into leaves that
    are spread over the cluster, encoded alone and put together again: between parts of the pattern by concatenation, inside an
    unsplit run by a tree of joins that is exact (see ``Encoder.join``).
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row_id"]
    result = f"row_id {kind}, n_tokens int" if counts else f"row_id {kind}, ids array<int>"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(name, home).ids
        for batch in batches:
            got = [ids(t) for t in batch.column("text").to_pylist()]
            out = pa.array([len(g) for g in got], pa.int32()) if counts else pa.array(got, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), out], names=["row_id", "n_tokens" if counts else "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(name, home)
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                group: list[tuple[int, bytes]] = []
                at = 0
                for kind_and_part in made.leaves(t, leaf):
                    group.append(kind_and_part)
                    if len(group) >= 64:
                        yield _leaf_batch(batch, i, at, group)
                        at, group = at + len(group), []
                if group:
                    yield _leaf_batch(batch, i, at, group)

    def _leaf_batch(batch: pa.RecordBatch, i: int, at: int, group: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(group)
        index = pa.array([i] * n, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("row_id").take(index), batch.column("line").take(index), pa.array(range(at, at + n), pa.int32()), pa.array([g[0] for g in group], pa.int32()), pa.array([g[1] for g in group], pa.binary())], names=["row_id", "line", "part", "kind", "piece"])

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(name, home)
        for batch in batches:
            got = pa.array([made.leaf_ids(p, k) for p, k in zip(batch.column("piece").to_pylist(), batch.column("kind").to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "line", "part", "kind")), got], names=["row_id", "line", "part", "kind", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(name, home)
        for batch in batches:
            for i in range(batch.num_rows):
                whole: list[int] = []
                run: list[list[int]] = []
                for leaf_row in batch.column("leaves")[i].as_py():
                    if leaf_row["kind"] != MORE and run:
                        whole += made.tree(run)
                        run = []
                    run.append(leaf_row["ids"])
                whole += made.tree(run)
                out = pa.array([len(whole)], pa.int32()) if counts else pa.array([whole], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(i, 1), out], names=["row_id", "n_tokens" if counts else "ids"])

    is_long = F.length("text") > leaf
    near = spread(rows.where(~F.coalesce(is_long, F.lit(False)))).mapInArrow(short, result)
    long = rows.where(is_long).withColumn("line", F.monotonically_increasing_id())
    made = long.mapInArrow(cut, f"row_id {kind}, line bigint, part int, kind int, piece binary")
    dealt = made.repartition(width(df.sparkSession), "line", "part")
    coded = dealt.mapInArrow(leaf_ids, f"row_id {kind}, line bigint, part int, kind int, ids array<int>")
    far = coded.groupBy("line").agg(F.first("row_id").alias("row_id"), F.sort_array(F.collect_list(F.struct("part", "kind", "ids"))).alias("leaves")).select("row_id", "leaves").mapInArrow(stitch, result)
    return near.union(far)

"""Cuts a cell that packs several values into its values, guided by a dictionary of known whole values."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick

from lumenweave.functions.text import SPACE

# How values are listed. A hard separator never stands inside a name; a soft one may.
HARD = "|¦｜;；\n\r\t\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SOFT = r"\s*[,，、]\s*(?:(?:and|&)\s+)?|\s+/\s+|/|\s+(?:and|&|\+)\s+"
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‟": "”"}
STRAY = "\"“”„«»‟"
MARK = re.compile(r"(?:(?<=^)|(?<=[\s,;|]))\(?(\d{1,3})[.)]\s+")
ID = re.compile(r"-1|[A-Za-z]+[:_]?\d+")
NO_CELL = {"", "nan", "-1"}

KNOWN, UNKNOWN, DANGLING = 1, 8, 30
JOIN, SPLIT_AFTER_HARD, BARE_SLASH, IMPOSSIBLE = 12, 20, 3, 10_000

#: A cell matching one of these may hold several values; any other holds one at most. Java and Python read them alike. Hard separators
#: part values wherever they stand; what the second finds takes the automaton.
MAYBE_HARD = r"[|¦｜;；\n\r\t\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
MAYBE_MORE = r'[,，、/&+"“”„«»‟\[\]{}]' + rf"|{SPACE}and{SPACE}|\d[.)]{SPACE}"
MAYBE_MANY = f"{MAYBE_HARD}|{MAYBE_MORE}"
#: Ids listed with blanks only.
MAYBE_IDS = rf"\d{SPACE}+-?\w"


def squeeze(text: str) -> tuple[str, list[int]]:
    """Lower case with each run of white space one blank; and for each character the place it comes from."""
    out, at, blank = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                out.append(" ")
                at.append(i)
            blank = True
            continue
        blank = False
        low = c.lower()
        for x in low:
            out.append(x)
            at.append(i)
    return "".join(out), at


def normal(text: str) -> str:
    return squeeze(text.strip())[0]


class Segmenter:
    """Multi-pattern automaton over the known values, and the cheapest cover of a cell by values.

    ``segment(cell)`` gives the values of a cell in order, as written. Hard separators always part values, except inside
    a known value. A soft separator (comma, spaced slash, "and", "&", "+") parts values unless it stands inside a known
    value, inside balanced parentheses, between digits of a locant such as ``3,6-``, or before a tail that known values
    share (``, type 2``), which is learned from the dictionary. White space parts values only where all pieces are ids.
    Known values win over unknown ones; quoted text is one value unless it is itself a list of known values. Null, blank,
    ``nan`` and ``-1`` alone give no value; blank pieces are dropped; quotation marks, brackets and numbering are not part
    of a value. A mark without its partner is dropped. Repeated values stay, each with its own position.
    """

    def __init__(self, known: Iterable[str], cache: int = 50_000):
        self.names = {n for n in (normal(x) for x in known if x) if n}
        self.automaton = ahocorasick.Automaton()
        for name in self.names:
            self.automaton.add_word(name, len(name))
        if self.names:
            self.automaton.make_automaton()
        self.tails = self._tails()
        self.widest = max((len(re.findall(SOFT, t)) for t in self.tails), default=0)
        self._soft = re.compile(SOFT)
        self.segment = lru_cache(maxsize=cache)(self._segment)

    def _tails(self) -> set[str]:
        """What follows a soft separator in at least two known values with different beginnings."""
        heads: dict[str, set[str]] = {}
        for name in self.names:
            for m in re.finditer(SOFT, name):
                tail = name[m.end() :]
                if tail and name[m.start()] != "/":
                    heads.setdefault(tail, set()).add(name[: m.start()])
                for part in re.split(SOFT, tail):
                    if part and name[m.start()] != "/":
                        heads.setdefault(part, set()).add(name[: m.start()])
        return {t for t, h in heads.items() if len(h) > 1 and not t[0].isdigit() and t not in self.names}

    def _segment(self, cell: str | None) -> tuple[str, ...]:
        if cell is None:
            return ()
        text = cell.strip()
        if text.lower() in NO_CELL:
            return ()
        if text[0] in "[{" and text[-1] == {"[": "]", "{": "}"}[text[0]]:
            items = self._literal(text[1:-1])
            if items is not None:
                got = [x for x in (y.strip() for y in items) if x]
                return () if len(got) == 1 and got[0].lower() in NO_CELL else tuple(got)
            text = text[1:-1].strip()
        found = self._cover(text)
        if len(found) == 1 and found[0].lower() in NO_CELL:
            return ()
        return tuple(found)

    @staticmethod
    def _literal(inner: str) -> list[str] | None:
        """Items of a list of quoted strings, or None if it is no such list."""
        items, i, n = [], 0, len(inner)
        while i < n:
            while i < n and (inner[i].isspace() or inner[i] == ","):
                i += 1
            if i >= n:
                break
            q = inner[i]
            if q not in "'\"":
                return None
            i, got, closed = i + 1, [], False
            while i < n:
                c = inner[i]
                if c == "\\" and i + 1 < n:
                    got.append(inner[i + 1])
                    i += 2
                elif c == q:
                    i, closed = i + 1, True
                    break
                else:
                    got.append(c)
                    i += 1
            rest = inner[i:].lstrip()
            if not closed or (rest and rest[0] != ","):
                return None
            items.append("".join(got))
        return items

    def _quoted(self, text: str) -> list[tuple[int, int]]:
        """Spans of quoted values, marks included: opened where a value may begin, closed where one may end."""
        spans, i, n, fresh = [], 0, len(text), True
        while i < n:
            c = text[i]
            if fresh and c in QUOTES:
                j = i + 1
                while (j := text.find(QUOTES[c], j)) != -1:
                    if text[j : j + 2] == '""' and j > i + 1:
                        j += 2
                        continue
                    rest = text[j + 1 :].lstrip("  ")
                    if not rest or rest[0] in HARD or self._soft.match(text[j + 1 :]):
                        break
                    j += 1
                if j != -1 and not any(h in text[i + 1 : j] for h in HARD):
                    spans.append((i, j + 1))
                    i, fresh = j + 1, False
                    continue
            if c in HARD or c in ",，、/&+":
                fresh = True
            elif not c.isspace():
                fresh = text[max(0, i - 3) : i + 1].lower() in (" and", " and")
            i += 1
        return spans

    def _cover(self, text: str) -> list[str]:
        low, at = squeeze(text)
        quoted = self._quoted(text)
        shut = [False] * (len(text) + 1)
        for a, b in quoted:
            if not self._is_list(text[a + 1 : b - 1]):
                for k in range(a, b):
                    shut[k] = True
        depth = 0
        opens = text.count("(") == text.count(")")
        inside = [False] * (len(text) + 1)
        for k, c in enumerate(text):
            if c == "(":
                depth += 1
            inside[k] = opens and depth > 0
            if c == ")":
                depth = max(0, depth - 1)
        cuts: list[tuple[int, int, str]] = []
        for k, c in enumerate(text):
            if c in HARD and not shut[k]:
                cuts.append((k, k + 1, "hard"))
        for m in self._soft.finditer(text):
            a, b = m.span()
            if shut[a] or inside[a] or any(text[k] in HARD for k in range(a, b)):
                continue
            mid = m.group().strip()
            if mid[:1] in ",，、" and a and text[a - 1].isdigit() and b == a + 1 and re.match(r"\d+'*-", text[b:]) and not self._edge_known(low, at, a):
                continue
            cuts.append((a, b, "slash" if mid == "/" and b == a + 1 else "soft"))
        marks = [m for m in MARK.finditer(text) if not shut[m.start()]]
        if marks and [int(m.group(1)) for m in marks] == list(range(1, len(marks) + 1)) and not text[: marks[0].start()].strip():
            cuts += [(*m.span(), "hard") for m in marks]
        if not cuts and not quoted:
            pieces = text.split()
            if len(pieces) > 1 and all(ID.fullmatch(p.strip(STRAY)) for p in pieces):
                return [p.strip(STRAY) for p in pieces]
            return self._clean([text])
        cuts.sort()
        merged: list[list] = []
        for a, b, kind in cuts:
            if merged and a <= merged[-1][1] and (kind != "slash" or a < merged[-1][1]):
                merged[-1][1] = max(merged[-1][1], b)
                if kind == "hard":
                    merged[-1][2] = "hard"
            else:
                merged.append([a, b, kind])
        hard = any(k == "hard" for _, _, k in merged)
        starts, ends, kinds, begin = [], [], [], 0
        for a, b, kind in merged:
            starts.append(begin)
            ends.append(a)
            kinds.append(kind)
            begin = b
        starts.append(begin)
        ends.append(len(text))
        n = len(starts)
        known = self._known_spans(text, low, at, starts, ends)
        ending: dict[int, list[int]] = {}  # beginnings of the known values that end before a place, last first
        for i, j in sorted(known, reverse=True):
            ending.setdefault(j, []).append(i)
        bare = [normal(text[a:b].strip().strip(STRAY)) for a, b in zip(starts, ends)]
        best: list[tuple[int, int]] = [(0, 0)] + [(IMPOSSIBLE * IMPOSSIBLE, 0)] * n

        def left(i: int, is_known: bool) -> int:
            """What it costs to begin a value at piece ``i``."""
            if not i or kinds[i - 1] == "hard":
                return 0
            if kinds[i - 1] == "slash":
                return BARE_SLASH if is_known else JOIN
            return SPLIT_AFTER_HARD if hard and not (is_known and (best[i][1], i) in known) else 0

        for j in range(1, n + 1):
            joins, some, i = 0, False, j - 1
            while i >= 0:  # values of pieces i to j - 1, as long as they may still be the cheapest
                if i < j - 1:
                    if kinds[i] == "hard":
                        break
                    if not (kinds[i] == "slash" or hard or bare[i + 1] in self.tails or (j - i - 2 <= self.widest and normal(text[starts[i + 1] : ends[j - 1]]) in self.tails)):
                        joins += JOIN
                    if joins > JOIN * (1 + self.widest):  # a cut there would be cheaper, but for separators inside a tail
                        break
                some = some or bool(bare[i])
                if (i, j) in known:
                    cost = KNOWN
                elif i == j - 1:
                    cost = 0 if not some else DANGLING if i and bare[i] in self.tails else UNKNOWN
                else:
                    cost = UNKNOWN + joins if some else IMPOSSIBLE
                cost += best[i][0] + left(i, (i, j) in known)
                if cost < best[j][0]:
                    best[j] = (cost, i)
                i -= 1
            for k in ending.get(j, ()):
                if k <= i and (cost := best[k][0] + KNOWN + left(k, True)) < best[j][0]:
                    best[j] = (cost, k)
        out, j = [], n
        while j:
            i = best[j][1]
            out.append(text[starts[i] : ends[j - 1]])
            j = i
        values = self._clean(out[::-1])
        flat = []
        for v in values:
            pieces = v.split()
            if len(pieces) > 1 and all(ID.fullmatch(p) for p in pieces) and any(":" in p for p in pieces):
                flat += pieces
            else:
                flat.append(v)
        return flat

    def _known_spans(self, text: str, low: str, at: list[int], starts: list[int], ends: list[int]) -> set[tuple[int, int]]:
        """Pairs (i, j) such that the pieces i to j - 1 together spell a known value."""
        if not self.names:
            return set()
        drop = STRAY + " "
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for k, (a, b) in enumerate(zip(starts, ends)):
            while a < b and (text[a].isspace() or text[a] in drop):
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in drop):
                b -= 1
            if a < b:
                first[a] = k
                last[b - 1] = k
        out = set()
        for end, size in self.automaton.iter(low):
            a, b = at[end - size + 1], at[end]
            if a in first and b in last and first[a] <= last[b]:
                out.add((first[a], last[b] + 1))
        return out

    def _edge_known(self, low: str, at: list[int], comma: int) -> bool:
        """Whether a known value ends right before this comma and no known value spans it."""
        if not self.names:
            return False
        ends = spans = False
        for end, size in self.automaton.iter(low):
            a, b = at[end - size + 1], at[end]
            if b == comma - 1 and (a == 0 or not low[end - size].isalnum()):
                ends = True
            if a < comma < b:
                spans = True
        return ends and not spans

    def _is_list(self, inner: str) -> bool:
        """Whether quoted text is a list of known values and not itself a known value."""
        if normal(inner) in self.names:
            return False
        parts = [p for p in re.split(SOFT, inner) if p.strip()]
        return len(parts) > 1 and all(normal(p) in self.names for p in parts)

    @staticmethod
    def _clean(values: list[str]) -> list[str]:
        out = []
        for v in values:
            v = v.strip()
            while v and (v[0] in STRAY or v[-1] in STRAY):
                v = v.strip(STRAY).strip()
            v = v.replace('""', '"')
            if v:
                out.append(v)
        return out

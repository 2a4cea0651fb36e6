import os
import random
import time

import numpy as np

from lumenweave.llm.split_overlap import SplitOverlap, distance_within, most_edits, prefix


def plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_distance():
    rnd = random.Random(3)
    for _ in range(3000):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(0, 24))]
        b = list(a) if rnd.random() < 0.5 else [rnd.randrange(5) for _ in range(rnd.randrange(0, 24))]
        for _ in range(rnd.randrange(0, 4)):
            if b:
                b[rnd.randrange(len(b))] = 9
        most = rnd.randrange(0, 8)
        want = plain_distance(a, b)
        assert distance_within(np.array(a, np.int64), np.array(b, np.int64), most) == (want if want <= most else most + 1)


def test_prefix_is_a_prefix_with_enough_disjoint_shingles():
    rng = np.random.default_rng(1)
    for n in (10, 11, 30, 200, 5000):
        own = rng.integers(1, 40, n - 4).astype(np.uint64)
        rank, k = (own % np.uint64(7)).astype(np.int64), most_edits(n) + 1
        got = sorted(prefix(own, rank, k, 5).tolist())
        key = lambda i: (rank[i], own[i])
        last = max(map(key, got))
        assert got == [i for i in range(n - 4) if key(i) <= last]
        ends, count = -1, 0
        for i in got:
            if i > ends:
                ends, count = i + 4, count + 1
        assert count >= k or len(got) == n - 4


def test_against_brute_force(spark):
    rnd = random.Random(7)
    base = [[f"w{rnd.randrange(60)}" for _ in range(rnd.choice([1, 3, 5, 8, 9, 10, 11, 12, 19, 20, 21, 40, 90]))] for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 3 + len(w) // 8)):
            op, at = rnd.randrange(3), rnd.randrange(len(w))
            if op == 0:
                w[at] = "new"
            elif op == 1 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, "ins")
        rows.append((i, rnd.choice(["train", " Train", "DEV", "test ", None, "other"]), [x.upper() if rnd.random() < 0.2 else x for x in w] + rnd.choice([[], ["."], [None], [" "]]), "s"))
    rows += [(1000, "train", None, "s"), (1001, "test", [], "s"), (1002, "dev", ["..."], "s"), (1003, "train", ["..."], None)]
    df = spark.createDataFrame(rows, "id bigint, sp string, toks array<string>, source string").selectExpr("*", "1 as rep", "'x' as split")
    want = set()
    side = lambda s: {"train": "t", "dev": "e", "test": "e"}.get((s or "").strip().lower())
    words = lambda t: [x.lower() for x in t or [] if x and x.strip(". ")]
    for i, s, t, _ in rows:
        for j, s2, t2, _ in rows:
            if side(s) == "t" and side(s2) == "e" and words(t) and words(t2):
                a, b = words(t), words(t2)
                if plain_distance(a, b) <= max(len(a), len(b)) // 10:
                    want.add((min(i, j), max(i, j)))
    o = SplitOverlap(df, "id", "sp", "toks", "source")
    got = [(r.rec_id_a, r.rec_id_b) for r in o.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    held = {(j if side(dict((r[0], r[1]) for r in rows)[j]) == "e" else i) for i, j in want}
    assert sum(r.overlapping for r in o.report().collect()) == len(held)
    links = {r.rec_id: r.links for r in o.membership().collect()}
    assert {i for i, n in links.items() if n} == {i for pair in want for i in pair} and len(links) == sum(bool(side(s) and words(t)) for _, s, t, _ in rows)
    twice = SplitOverlap(df.union(df), "id", "sp", "toks", "source").pairs()
    assert twice.count() == 4 * len(want) and {(r.rec_id_a, r.rec_id_b) for r in twice.distinct().collect()} == want
    assert SplitOverlap(df.limit(0), "id", "sp", "toks").pairs().count() == 0


def test_passes_find_the_same_and_leave_little_on_disk(spark, monkeypatch, tmp_path):
    from lumenweave.llm import split_overlap

    rnd = random.Random(11)
    rows = []
    for i in range(120):
        w = [f"w{rnd.randrange(40)}" for _ in range(rnd.choice([9, 10, 17, 26, 27, 40, 90, 200]))]
        rows.append((2 * i, "train", w))
        w = list(w)
        for _ in range(rnd.randrange(0, 2 + len(w) // 9)):
            w[rnd.randrange(len(w))] = "new"
            if rnd.random() < 0.3:
                w.insert(rnd.randrange(len(w)), "ins")
        rows.append((2 * i + 1, "dev", w))
    want = {(a[0], b[0]) if a[0] < b[0] else (b[0], a[0]) for a in rows[::2] for b in rows[1::2] if plain_distance(a[2], b[2]) <= max(len(a[2]), len(b[2])) // 10}
    df = spark.createDataFrame(rows, "id bigint, sp string, toks array<string>")
    monkeypatch.setattr(split_overlap, "PASS_WORDS", 2000)
    sizes, keep = {}, split_overlap.stored

    def noted(df, name):
        out, path = keep(df, name)
        sizes.setdefault(name, []).append((out.count(), path.removeprefix("file://")))
        return out, path

    monkeypatch.setattr(split_overlap, "stored", noted)
    blocks = lambda: sum(str(b).startswith("shuffle_") for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()))
    before = blocks()
    links = SplitOverlap(df, "id", "sp", "toks")
    near = links.pairs()
    index = [n for n, _ in sizes["overlap-index"]]
    assert len(index) > 2 and max(index) < 0.6 * sum(index)
    left = {name for name, tables in sizes.items() for _, path in tables if os.path.exists(path)}
    assert left == {"overlap-members", "overlap-classes", "overlap-near"}
    for _ in range(50):
        if blocks() <= before + 40:
            break
        time.sleep(0.2)
    assert blocks() <= before + 40  # what the last step, of pairs of records, shuffles; not the passes
    assert {(r.rec_id_a, r.rec_id_b) for r in near.collect()} == want and len(want) > 30

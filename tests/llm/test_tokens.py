import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.llm.packing import pack, pack_sizes, summary
from lumenweave.llm.tokenizing import HOME, MORE, Encoder, encode

pytestmark = pytest.mark.skipif(not os.path.exists(HOME), reason="no vocabulary files")


def joined(e, text, leaf):
    out, run = [], []
    for kind, part in e.leaves(text, leaf):
        if kind != MORE and run:
            out += e.tree(run)
            run = []
        run.append(e.leaf_ids(part, kind))
    return out + e.tree(run)


def test_leaves_are_exact():
    e, rnd = Encoder("byte_bpe_50k"), random.Random(5)
    letters = ["ab", "the quick fox ", "日本語中文", " \n", "'s't're ab12", "éàü öß-—…", "a1-_ ' \n\t", "Ⅷ½²x", "\x1c\x85 \xa0a", "🙂👍🏽 a", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(letters) if rnd.random() < 0.3 else rnd.choice(rnd.choice(letters)) for _ in range(rnd.randrange(80)))
        assert joined(e, text, rnd.choice([4, 8, 16])) == e.ids(text)


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    e, t = Encoder("byte_bpe_50k"), Tokenizer.from_file(os.path.join(HOME, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Effects of α-x on y's <|endoftext|> 12 µg/kg.\n\n  z", "日本語 🙂", " "):
        assert t.encode(text, add_special_tokens=False).ids == e.ids(text)


def test_encode(spark):
    e = Encoder("byte_bpe_50k")
    texts = [(1, None), (2, ""), (3, " "), (4, "Hello world"), (4, "Hello world"), (5, "a" * 5000), (6, "word " * 3000), (6, "word " * 3000), (7, "日本" * 2000), (None, "x")]
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("ids", F.lit(1))
    got = sorted((r.row_id or 0, list(r.ids)) for r in encode(df, "id", "text", leaf=256).collect())
    assert got == sorted((i or 0, e.ids(t)) for i, t in texts)
    n = sorted((r.row_id or 0, r.n_tokens) for r in encode(df, "id", "text", leaf=256, counts=True).collect())
    assert n == sorted((i or 0, len(e.ids(t))) for i, t in texts)
    assert encode(df.limit(0), "id", "text").count() == 0


def test_packing_rules():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(0, 300, 2000), rng.integers(600, 1100, 500), np.full(50, 700), np.zeros(5, int), np.zeros(0, int), np.full(9, 2048)):
        bins = pack_sizes(sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 2048 for b in bins)
    sizes = rng.integers(0, 300, 2000)
    assert len(pack_sizes(sizes, 2048)) <= -(-int(sizes.sum()) // 2048) + 1


def test_pack(spark):
    rows = [(i % 300, int(s)) for i, s in enumerate(np.random.default_rng(1).integers(0, 500, 3000))] + [(1, 5000), (2, None), (None, 2048), (None, 2049)]
    df = spark.createDataFrame(rows, "id bigint, n int").withColumn("piece", F.lit(1))
    got = pack(df, "id", "n", group=500)
    per = got.groupBy("container_id").agg(F.sum("n_tokens").alias("s"))
    assert per.agg(F.max("s")).first()[0] <= 2048
    assert got.agg(F.sum("n_tokens")).first()[0] == sum(n or 0 for _, n in rows)
    assert [(r.piece, r.begin, r.n_tokens) for r in got.where("row_id = 1 and begin + n_tokens > 2047").orderBy("piece").collect()] == [(1, 0, 2048), (2, 2048, 2048), (3, 4096, 904)]
    assert got.count() == len(rows) + 3
    assert summary(got).first().used > 0.97
    assert pack(df.limit(0), "id", "n").count() == 0 and summary(pack(df.limit(0), "id", "n")).first().containers == 0


def test_leaves_of_other_scripts():
    made = Encoder("byte_bpe_50k")
    rnd = random.Random(4)
    for letters, signs in (("中文字符测试", "，。！？；："), ("αβγδ", ",.·"), ("абвг", "«».—"), ("가나다", "."), ("éàüß", "¿¡'")):
        text = "".join(rnd.choice(letters) if rnd.random() < 0.9 else rnd.choice(signs) for _ in range(9000))
        parts = list(made.leaves(text, 500))
        assert len(parts) > 9 and b"".join(p for _, p in parts).decode() == text
        if all(k == 0 for k, _ in parts):
            assert [i for k, p in parts for i in made.leaf_ids(p, k)] == made.ids(text)

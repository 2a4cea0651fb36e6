import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenweave.llm.chunking import INSIDE, entity_of, pieces, segments, split_oversized, strengths


def tagged(rnd, n):
    toks, tags = [], []
    while len(toks) < n:
        if rnd.random() < 0.15:
            k = rnd.randrange(1, 9)
            toks += [f"e{i}" for i in range(k)]
            tags += ["B-DRUG"] + ["I-DRUG"] * (k - 1)
        toks.append(rnd.choice([".", ",", "w", "x", "y"]))
        tags.append("O")
    return toks[:n], tags[:n]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 900))
def test_pieces_hold_the_rules(seed, n):
    toks, tags = tagged(random.Random(seed), n)
    limit, overlap = 64, 16
    got = pieces(toks, tags, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == n
    for k, (a, b) in enumerate(got):
        assert 0 < b - a <= limit
        if k:
            assert a == got[k - 1][1] - overlap and b > got[k - 1][1]
        if b < n:
            assert not (entity_of(tags[b])[0] == "I" and entity_of(tags[b - 1])[0] != "O"), "ends inside an entity"
    if n <= limit:
        assert got == [(0, n)]


def test_sentence_ends_are_kept():
    toks = (["w"] * 9 + ["."]) * 60
    got = pieces(toks, ["O"] * 600, 64, 16)
    assert all(toks[b - 1] == "." for _, b in got)


def test_giant_entity_and_giant_record():
    n = 5000
    got = pieces(["e"] * n, ["B-X"] + ["I-X"] * (n - 1), 64, 16)
    assert got[-1][1] == n and all(b - a <= 64 for a, b in got)
    toks, tags = tagged(random.Random(1), 60_000)
    assert pieces(toks, tags)[-1][1] == 60_000


def test_segments_end_outside_entities():
    rnd = random.Random(5)
    for n in (65, 130, 700):
        toks, tags = tagged(rnd, n)
        bounds = strengths(toks, tags)
        got = segments(bounds, n, 64, 16)
        ends = [(i + 1) for i in range(n - 1) if bounds[i] != INSIDE] + [n]
        assert set(got) <= set(ends) and all(b - a <= 64 - 16 for a, b in zip(got, got[1:])) and got[0] <= 64


def test_records(spark):
    long = ["a", None, " ", "\xa0", ""] + ["t"] * 600
    rows = [(1, long, ["B-DRUG"]), (2, ["x"] * 512, None), (3, None, None), (4, [], []), (1, long, None), (5, ["x"] * 513, ["O"] * 600)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, tags array<string>").selectExpr("*", "1 as piece")
    got = split_oversized(df, "id", "tokens", "tags").collect()
    assert {r.rec_id for r in got} == {1, 5} and sum(r.piece == 1 for r in got) == 3
    assert all(len(r.tokens) == len(r.ner_tags) == r.n_tokens <= 512 and not any(t is None or not t.strip() for t in r.tokens) for r in got)
    first = next(r for r in got if r.rec_id == 1 and r.piece == 1 and r.ner_tags[0] == "B-DRUG")
    assert first.tokens[0] == "a" and set(first.ner_tags[1:]) == {"O"}
    assert split_oversized(df.limit(0), "id", "tokens", "tags").count() == 0

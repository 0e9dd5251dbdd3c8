"""Near copies against brute-force similarity of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from homologrid.llm import near_copies
from homologrid.llm.common import documents

FOLDER = "/root/testdata/sf0.001"


def shingles(text, words=5):
    tokens = text.encode().lower().split()
    return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def alike(a, b):
    return (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8


def brute_survivors(rows):
    """Smallest id of each class of all links of similarity 0.8 or more."""
    sets = [(i, shingles(t or "")) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if alike(a, b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {root(i) for i, _ in rows}


def edited(rng, words, upto=0.8):
    """A copy with words exchanged at random places as long as the similarity stays at ``upto`` or more."""
    given, now = shingles(" ".join(words)), list(words)
    for place in rng.sample(range(len(words)), len(words)):
        trial = [*now[:place], f"new{rng.random()}", *now[place + 1 :]]
        other = shingles(" ".join(trial))
        if len(given & other) / len(given | other) < upto:
            return " ".join(now)
        now = trial
    return " ".join(now)


def kept(df):
    return sorted(r.doc_id for r in near_copies.one_of_each_class(df).collect())


@pytest.mark.parametrize("upto", [0.8, 0.9])
def test_recall_of_copies_at_the_least_similarity(spark, upto):
    rng = random.Random(4)
    given = [r.text.split() for r in documents(spark, FOLDER).orderBy("doc_id").collect() if len((r.text or "").split()) >= 40]
    rows = []
    for i, words in enumerate(given):
        # Tokens of their own keep the originals apart from each other.
        own = [f"{w}{i}" for w in words]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, edited(rng, own, upto))]
    assert brute_survivors(rows) == set(range(0, len(rows), 2))
    found = kept(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(range(0, len(rows), 2)) <= set(found)
    assert 1 - (len(found) - len(given)) / len(given) >= 0.95


@pytest.mark.parametrize("tile", [512, 4])
def test_every_pair_at_the_least_similarity_is_linked(spark, monkeypatch, tile):
    """Pairs that share no band, or whose fingerprints are far apart; all texts share a common passage."""
    monkeypatch.setattr(near_copies, "TILE_ROWS", tile)
    monkeypatch.setattr(near_copies, "RADIUS", 3)
    rng = random.Random(6)
    common, rows = " ".join(f"line{i}" for i in range(12)), []
    for i in range(120):
        words = [f"w{i}x{j}" for j in range(rng.randrange(30, 90))]
        rows += [(2 * i, " ".join([common, *words])), (2 * i + 1, edited(rng, common.split() + words, 0.8))]
    found = kept(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == sorted(brute_survivors(rows)) == list(range(0, 240, 2))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 10, 45, 300):
        for _ in range(50):
            base = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
            a, b = np.unique(base[:n]), np.unique(base[rng.integers(0, n // 4 + 1) : n + rng.integers(0, n // 4 + 1)])
            last = np.sort(a[rng.random(len(a)) < 0.3] & np.uint64((1 << near_copies.KEY_BITS) - 1)).view(np.int64)
            if near_copies.similarity(a, b) >= 0.8:
                for late in (None, last):
                    assert np.intersect1d(near_copies.prefix(a, 0.8, late), near_copies.prefix(b, 0.8, late)).size


@pytest.mark.parametrize("tile", [512, 4])
def test_classes_of_dense_groups(spark, monkeypatch, tile):
    """Chains of near copies, a group of many copies, odd texts; large tiles go through both steps."""
    monkeypatch.setattr(near_copies, "TILE_ROWS", tile)
    rng = random.Random(9)
    rows, number = [], 0
    for group in range(4):
        words = [f"w{group}x{i}" for i in range(120)]
        for _ in range(15):
            rows.append((number, " ".join(words)))
            words = edited(rng, words, 0.9).split() if group else words
            number += 1
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "a b c d e f"), (1006, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bands int, fingerprint string")
    out = near_copies.one_of_each_class(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(brute_survivors(rows))


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    rows = [(None, "the same five words here now"), (3, "the same five words here now"), (3, "the same five words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == [3]
    assert kept(df.where("doc_id is null").union(df.where("doc_id is null"))) == [None]
    assert kept(df.limit(0)) == []


def test_similarity_of_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        assert near_copies.similarity(a, b) == (len(x & y) / len(x | y) if x | y else 1.0)


def test_long_texts_that_share_some_shingles_need_no_whole_sets(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4_000)]
    common = [" ".join(rng.choices(vocabulary, k=5)) for _ in range(300)]
    texts = []
    for _ in range(24):
        words = rng.choices(vocabulary, k=4_000)
        texts.append(" ".join([*words, *(" ".join(rng.choices(vocabulary, k=1)) + " " + c for c in common)]))
    texts.append(edited(rng, texts[0].split()[:800], 0.82))
    texts.append(" ".join(texts[0].split()[:800]))
    asked, inner = [], near_copies._with_sets
    monkeypatch.setattr(near_copies, "_with_sets", lambda rows, words: asked.append(rows.select("number").distinct().count()) or inner(rows, words))
    rows = list(enumerate(texts))
    assert kept(spark.createDataFrame(rows, "doc_id bigint, text string")) == sorted(brute_survivors(rows))
    # The last call is for the pairs that need their whole sets: of texts that share 300 of 5,800 shingles none does.
    assert asked[-1] <= 2


def test_what_lies_beyond_a_prefix():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, 120).astype(np.uint64) << np.uint64(int(rng.choice([0, 8, 33]))))
        b = np.unique(np.concatenate([rng.choice(a, 60), rng.integers(0, 400, 60).astype(np.uint64)]))
        late = np.sort(rng.choice(near_copies.prefix(a, 0.0), 5).view(np.int64))
        sides = []
        for x in (a, b):
            first = near_copies.prefix(x, 0.8, late)
            sides.append((set(first.tolist()), *near_copies.beyond(x, first, late)))
        (p, end_a, rest_a, extra_a), (q, end_b, rest_b, extra_b) = sides
        most = len(p & q) + (rest_a if end_a <= end_b else rest_b) + min(extra_a, extra_b)
        assert most >= len(np.intersect1d(a, b))

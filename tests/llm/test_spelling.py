"""Words, near words and forms against definitions written out directly."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from homologrid.llm import spelling
from homologrid.llm.common import documents

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    out = {}
    for word, n in words.items():
        near = [w for w in words if abs(len(w) - len(word)) < 2 and one_edit(w, word)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[word] = (form, n, len(near), words.get(form))
    result = set()
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        result.add((word, form, root, n, near, form_n))
    return result


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture
def planted(spark):
    """Chains of forms, copies of letters, long words, ties and odd rows."""
    # Ids whose checksum damages none of the repeated words would hide chains; counts are large enough.
    words = ["banana" * 2, "bananaanana", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "straßenÿe", "STRASSENe", "x" * 900, "x" * 899]
    chain = {"abcdefgh": 700, "abcdefghi": 60, "abcdefghij": 4, "abcdefgx": 3, "zbcdefgh": 3}
    texts = [" ".join(words)] * 3 + [" ".join([w] * n) for w, n in chain.items()]
    texts += [None, "", "12 34", "short", "abcdefgh-abcdefgh×abcdefgh"]
    rows = [(i if i != 2 else None, t, 1) for i, t in enumerate(texts)]
    rows.append(rows[3])
    return rows, spark.createDataFrame(rows, "doc_id long, text string, word int")


def test_planted_words_match_brute_force(planted):
    rows, docs = planted
    found = rows_of(spelling.spelling_variants(docs))
    assert found == brute([(r[0], r[1]) for r in rows])
    assert ("abcdefghij", "abcdefghi", "abcdefgh") in {r[:3] for r in found}


def test_blocks_of_one_tile_change_nothing(planted, monkeypatch):
    rows, docs = planted
    monkeypatch.setattr(spelling, "TILE_ROWS", 2)
    monkeypatch.setattr(spelling, "PAIRS", 3)
    assert rows_of(spelling.spelling_variants(docs)) == brute([(r[0], r[1]) for r in rows])


def test_documents_match_sql_and_brute_force(spark):
    found = rows_of(spelling.op13_spelling_variants(spark, FOLDER))
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
        told = db.execute(f"select word, form, root, n, n_near, form_n from ({spelling.SQL})").fetchall()
    assert found == set(told)
    assert found == brute([(r.doc_id, r.text) for r in documents(spark, FOLDER).collect()])


def test_random_words_over_a_small_alphabet():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abß"), rng.integers(7, 10))) for _ in range(400)})
    m = max(map(len, words))
    got = set()
    for longer in range(7, m + 1):
        here = [w for w in words if longer - 1 <= len(w) <= longer]
        for side in (False, True):
            half = longer // 2
            keys = [w[-half:] if side else w[:half] for w in here] * 2
            number = {k: i for i, k in enumerate(sorted(set(keys)))}
            resident = np.array([len(w) == longer for w in here] + [False] * len(here))
            # Shorter words only answer.
            use = np.array([len(w) == longer for w in here] + [True] * len(here))
            rows = np.flatnonzero(use)
            both = [(here * 2)[i] for i in rows]
            a, b = spelling.near_pairs(
                both,
                np.array([number[keys[i]] for i in rows]),
                resident[rows],
                np.full(len(rows), longer),
                np.full(len(rows), side),
            )
            new = [tuple(sorted((both[i], both[j]))) for i, j in zip(a, b)]
            assert all(one_edit(x, y) for x, y in new)
            got.update(new)
    assert got == {(x, y) for x in words for y in words if x < y and one_edit(x, y)}


def test_an_empty_table_gives_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, best string")
    out = spelling.spelling_variants(empty)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0

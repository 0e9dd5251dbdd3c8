from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from homologrid.llm.mixing import Mix, _permuted, mixed_documents

SCHEMA = "doc_id long, text string, source string, n_chars long, mixed_mark string"


def shared_again(sizes: dict, weights=(5, 2, 1), passes=3) -> dict:
    """Targets by sharing and resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > passes * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: float(passes * sizes[s]) for s in over}


def docs_of(spark):
    rows = []
    for i in range(300):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None
        rows.append((i, " ".join(f"w{i}.{j}" for j in range(i % 50 * (40 if i % 97 == 5 else 1))), source, 1, "x"))
    rows += [(300, "tiny  words\there", "a tiny source", 5, None), (301, None, "empty", None, None)]
    rows += [(302, "again and again", "s1", 15, "r")] * 3 + [(None, "no id", "s1", 5, None)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.mark.parametrize("block", [7, 1024])
def test_taken_words_meet_the_targets(spark, block):
    docs, rows = docs_of(spark)
    mix = Mix(docs, block=block, shard_slots=16)
    got = mix.taken().collect()
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.id), r.size) for r in got) == sorted((str(i), size_of(t)) for i, t, *_ in rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert target == pytest.approx(shared_again(sizes))
    assert {r.source: r.source_size for r in got} == sizes
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    # Every full pass reads every block once; shards are full but for the last.
    slots = mix.slots.collect()
    passes = {(s.source, s["pass"]) for s in slots}
    for source, number in passes:
        blocks = [s.block for s in slots if (s.source, s["pass"]) == (source, number)]
        assert len(set(blocks)) == len(blocks)
    assert sorted(16 * s.shard + s.position for s in slots) == list(range(len(slots)))
    again = Mix(docs.repartition(5), block=block, shard_slots=16).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_documents_of_the_mix(spark):
    docs, rows = docs_of(spark)
    mixed = mixed_documents(docs, block=7)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    want = sum(r.taken for r in Mix(docs, block=7).taken().collect())
    assert sum(len(r.text.split()) for r in out) == want
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).update((t or "").split())
    assert all(set(r.text.split()) <= texts[r.doc_id] for r in out)
    whole = {t for _, t, *_ in rows}
    assert all(r.text in whole or r.n_chars == len(r.text) for r in out)


def test_empty_tables(spark):
    docs, _ = docs_of(spark)
    assert Mix(docs.limit(0)).taken().count() == 0 and mixed_documents(docs.limit(0)).count() == 0
    wordless = docs.where("text is null")
    assert [r.taken for r in Mix(wordless).taken().collect()] == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 31, 577, 5000])
def test_permutations(spark, n):
    numbers = spark.range(n).select(_permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("k")))
    assert sorted(r[0] for r in numbers.collect()) == list(range(n))


def test_shards_hold_the_mix(spark):
    docs, _ = docs_of(spark)
    mix = Mix(docs, block=7, shard_slots=16)
    shards = {(r.shard, r.source): (r.slots, r.words) for r in mix.shards().collect()}
    pieces = mix.shard_pieces().collect()
    words, places = {}, {}
    for p in pieces:
        words[p.shard, p.source] = words.get((p.shard, p.source), 0) + p.words
        places.setdefault((p.shard, p.source), set()).add(p.position)
    assert words == {k: w for k, (_, w) in shards.items()}
    assert {k: len(v) for k, v in places.items()} == {k: n for k, (n, _) in shards.items()}
    # Every shard but the last is full, and no place is dealt twice.
    full = {}
    for (shard, _), (n, _) in shards.items():
        full[shard] = full.get(shard, 0) + n
    assert all(n == 16 for shard, n in full.items() if shard != max(full))
    for row in mix.taken().collect():
        mine = [p for p in pieces if p.id == row.id and p.source == row.source]
        if row.taken:
            assert row.first_shard >= min(p.shard for p in mine) and row.last_shard <= max(p.shard for p in mine)
        else:
            assert row.pieces == 0 and row.first_shard is None

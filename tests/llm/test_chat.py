from __future__ import annotations

import random

from homologrid.llm.chat import formatted

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def plain(rows):
    key = lambda x: (x is not None, x)
    said = {}
    for conv, turn, role, text, *_ in rows:
        said.setdefault(conv, []).append((key(turn), key(role), key(text)))
    said = {c: [(r[1], t[1]) for _, r, t in sorted(v)] for c, v in said.items()}
    out = []
    for conv, turns in said.items():
        same = [c for c, o in said.items() if o == turns]
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in said.values())
        if not longer and conv == min((c for c in same if c is not None), default=None):
            for i, (role, text) in enumerate(turns):
                out.append((conv, i + 1, len(turns), len(same), f"<|{role if role is not None else 'unknown'}|>\n{text or ''}<|end|>\n"))
    return out


def check(spark, rows):
    got = formatted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))


def test_random_conversations(spark):
    rng = random.Random(0)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn * rng.choice((1, 1, 700)), rng.choice(("user", "user", "bot")), rng.choice("aab"), "x"))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi", None), (1, 1, None, None, None), (2, 0, "user", "hi", None), (2, 1, "", "", None)]
    rows += [(3, 0, "user", "hi", None), (4, 0, "user", "hi", None), (4, 1, None, None, None), (4, 2, "bot", "x" * 50_000, None)]
    rows += [(5, None, "a", "b", None), (5, 3, "a", "c", None), (5, 3, "a", "c", None), (None, 1, "u", "alone", None)]
    rows += [(6, i, "user", f"line {i}", None) for i in range(3_000)] + [(7, i, "user", f"line {i}", None) for i in range(2_500)]
    check(spark, rows)
    assert formatted(spark.createDataFrame([], SCHEMA)).count() == 0

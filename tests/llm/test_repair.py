"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from homologrid.llm import repair
from homologrid.llm.common import table
from homologrid.staging import StageArea

FOLDER = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        yield conv, turn, role, text
        if fault == 3:
            yield conv, turn, role, text


def search(rows):
    """Cheapest and then least string of edits by plain recursion from the end, with the lines they give."""
    best = {}
    for i in range(len(rows), -1, -1):
        now = {}
        for state in ("", "s", "u", "a"):
            options = []
            if i == len(rows):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                role, text, fault = rows[i]
                cost, letters, lines = best[i + 1][state]
                options.append((cost + 2, "D" + letters, lines))
                extra = 5 if fault == "truncated" else 0
                if fault not in ("blank", "duplicate"):
                    for letter, kept, price in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                        to = STEPS.get((state, kept[:1]))
                        if to is not None:
                            cost, letters, lines = best[i + 1][to]
                            options.append((cost + price + extra, letter + letters, (f"{kept}:{text}",) + lines))
            now[state] = min(options, default=(10**9, "", ()))
        for _ in range(4):
            for state in now:
                for role in ("user", "assistant"):
                    to = STEPS.get((state, role[0]))
                    if to is not None:
                        cost, letters, lines = now[to]
                        now[state] = min(now[state], (cost + 5, "I" + letters, (f"{role}:",) + lines))
        best[i] = now
    return best[0][""]


def brute(rows):
    groups = defaultdict(list)
    for conv in {r[0] for r in rows}:
        groups[conv] = []
    for row in damage(rows):
        groups[row[0]].append(row)
    out = {}
    for conv, mine in groups.items():
        mine.sort(
            key=lambda r: (
                r[1] is not None, r[1] or 0, r[2].encode(),
                hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest(),
            )
        )
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in mine:
            ink = text.rstrip(WHITE)
            faults.append(
                "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = search([(r[2], r[3], f) for r, f in zip(mine, faults)])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (conv, gaps, *counts, illegal, cost, audit, digest)
    return set(out.values())


def rows_of(df):
    assert df.columns[:9] == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ]
    return {tuple(r)[:9] for r in df.collect()}


@pytest.fixture
def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \n", None, "a ", "Eh? ", "so!\n\n", "x" * 40_000, "x" * 40_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "unit"]
    rows = []
    for conv in [None, *range(40), 2**62]:
        for turn in range(rng.randrange(1, 14)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"Turn {turn}." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, turn, None, 0, -5]), role, text))
    rows += [(7, 1, "user", "again.")] * 5 + [(50, -(2**63), "user", "a."), (50, 2**63 - 1, "user", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, no int, key string"
    )


def test_odd_rows_match_the_search(spark, odd_rows):
    assert rows_of(repair.repaired(frame(spark, odd_rows))) == brute_longs(odd_rows)


def brute_longs(rows):
    # A range beyond longs has no number of gaps.
    return {(r[0], 0, *r[2:]) if r[1] >= 2**63 else r for r in brute(rows)}


def test_small_chunks_change_nothing(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 3)
    hot = [(99, i, ("user", "assistant")[i * i % 7 % 2], f"t{i}" + ".," [i % 5 == 0]) for i in range(120)]
    rows = odd_rows + hot
    assert rows_of(repair.repaired(frame(spark, rows))) == brute_longs(rows)


def test_speculation_converges_in_few_passes(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 16)
    roles = ("user", "assistant")
    rows = [(1, i, roles[(i + i // 37) % 2], f"text {i}" + ".,"[i % 9 == 0]) for i in range(1500)]
    area = StageArea(spark, "test")
    placed = area.write(repair.ordered(repair.damaged(frame(spark, rows).withColumnRenamed("conv_id", "conv"))), "rows")
    live = area.write(repair.live_rows(placed), "live")
    parts, passes = repair.stitched(live, area)
    assert parts.count() > 60 and passes <= 4


def test_every_code_and_vector_agrees_with_the_search():
    rng = random.Random(11)
    for _ in range(300):
        codes = [rng.choice("sua-") + rng.choice("t--") for _ in range(rng.randrange(1, 12))]
        roles = {"s": "system", "u": "user", "a": "assistant", "-": "other"}
        rows = [(roles[c[0]], "x", "truncated" if c[1] == "t" else "") for c in codes]
        own, _ = repair.traced(codes, repair.END, True, (0,))
        body, _, tail = "".join(own[0]).partition(".")
        assert body + tail == search(rows)[1]


def test_conversations_match_the_search(spark):
    given = table(spark, FOLDER, "conversations").collect()
    assert rows_of(repair.op12_conversation_repair(spark, FOLDER)) == brute(
        [(r.conv_id, r.turn, r.role, r.text) for r in given]
    )


def test_an_empty_table_and_dropped_conversations(spark):
    assert repair.repaired(frame(spark, [])).count() == 0
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = rows_of(repair.repaired(frame(spark, [(gone, 0, "user", "a.")])))
    assert row == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())

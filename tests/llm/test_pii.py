from __future__ import annotations

import hashlib
import random
import re

from homologrid.llm.common import documents
from homologrid.llm.pii import KINDS, op4_pii, PersonalData

FOLDER = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [
        (m.start(), KINDS.index(k), m.end(), f"{k}:{m.start()}:{m.end()}")
        for k, p in PLAIN.items()
        for m in re.finditer(p, text or "")
        if holds(k, m[0])
    ]
    return [x[-1] for x in sorted(found)]


def check(rows, got):
    by_id = {r.doc_id if hasattr(r, "doc_id") else r.id: r for r in got}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want, row = plain_spans(text), by_id[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (doc_id, text[:300], row.spans, want)
        assert [row[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert set(want) <= set(row.spans.split(",")) or not want
        yield doc_id, [s for s in row.spans.split(",") if s and s not in want]


def test_base_spans_of_a_table(spark):
    rows = [tuple(r) for r in documents(spark, FOLDER).select("doc_id", "text").collect()]
    for _ in check(rows, op4_pii(spark, FOLDER).collect()):
        pass


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(0)
    parts = ["a@b.c", "@", ".", "-", "+", "1", "12", "255", "256", "0001", " ", "é", "(", ")", "%", "4111 1111 1111 1111", "+1 (523) 555-1055", "1.2.3.4", "x", "\n", "😀"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "9" * 6_000), (5003, "1-" * 4_000), (5004, "x@" + "a." * 30_000 + "b")]
    rows += [(5005, "a" * 6_000), (5006, "+1" + "(" * 30_000), (5007, "1." * 3_000), (5008, "1.2.3.4 " * 3_000), (None, "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for _ in check(rows, PersonalData(docs).listed().collect()):
        pass
    assert PersonalData(docs.limit(0)).listed().count() == 0


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(i, f"some words e-mail: user{i}@mail{i % 3}.org thanks item 77 and {i} more") for i in range(12)]
    rows += [(100, "please e-mail: root@localhost thanks"), (101, "the e-mail: 12 thanks"), (102, "see me@home there")]
    rows += [(200 + i, f"the number {1000 + i} of the 4111111111111111 number") for i in range(9)]
    # A copy of one document many times adds no support.
    rows += [(300 + i, "call now +1 (523) 555-1055 today") for i in range(30)] + [(400, "call now 555-1055 today")]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    extra = dict(check(rows, PersonalData(docs).listed().collect()))
    assert {k: v for k, v in extra.items() if v} == {100: ["email:15:29"]}


def test_contexts_reveal_identifiers_of_several_tokens(spark):
    rows = [(i, f"some words tel2: +1 (523) 555-10{i} today") for i in range(10, 50)]
    rows += [(100, "some words tel2: (743) 555-3824 today"), (101, "some words tel2: 743 555 3824 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    extra = dict(check(rows, PersonalData(docs).listed().collect()))
    assert {k: v for k, v in extra.items() if v} == {100: ["phone:17:31"], 101: ["phone:17:29"]}


def test_words_beside_matches_are_contexts(spark):
    rows = [(0, "x1 y2 z3 555-1055 a4 b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.value: (r.left, r.right) for r in PersonalData(docs).tokens.collect()}
    assert found["555-1055"] == ("z3", "a4") and found["y2"] == ("x1", "z3")

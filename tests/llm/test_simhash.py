from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from homologrid.llm.components import components
from homologrid.llm.simhash import fingerprint, links, near_duplicates, one_of_each
from homologrid.staging import StageArea


def plain_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(marks):
    """Smallest non-null id reachable, by brute force over rows (id, mark)."""
    n = len(marks)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if (marks[i][1] ^ marks[j][1]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = {}
    for i, (doc_id, _) in enumerate(marks):
        ids.setdefault(label[i], []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [least[label[i]] for i in range(n)]


def test_fingerprint_is_the_majority_of_the_shingle_hashes():
    rng = np.random.default_rng(0)
    texts = ["", " \n\t", "One", "one two", "Über ÉCOLE  straße\x0bend", "a b   c d"]
    texts += [" ".join(rng.choice(["The", "cat", "sat", "é", "x1"], k)) for k in (3, 257, 258, 700)]
    for text in texts:
        assert fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def near_marks():
    rng = np.random.default_rng(1)
    marks = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in marks[:6]:
        for k in range(12):
            base ^= 1 << int(rng.integers(0, 64))
            if k % 3:
                base ^= 1 << int(rng.integers(0, 64))
            marks.append(base)
    return sorted({0, 1, 6, *marks})


@pytest.mark.parametrize("fields", [2, 8])
def test_links_span_the_classes(spark, fields):
    marks = near_marks()
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    found = links(spark.createDataFrame(signed, "fingerprint long"), fields=fields)
    roots = dict(components(found, StageArea(spark, "test")).collect())
    for (a, _), (b, _) in [(e, e) for e in found.collect()]:
        assert a in roots and b in roots
    want = plain_classes([(i, m) for i, m in enumerate(marks)])
    got = {}
    for i, (m,) in enumerate(signed):
        got.setdefault(roots.get(m, m), []).append(i)
    assert sorted(got.values()) == sorted(
        [[i for i in range(len(marks)) if want[i] == c] for c in set(want)]
    )


def test_near_duplicates_and_survivors(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, base + f" end{i % 5}", "x") for i in range(20)]
    rows += [(50, None, "n"), (51, "", "e"), (None, "", "z"), (60, "hot", "h"), (60, "hot", "h"), (None, "lonely", None)]
    rows += [(70 + i, f"other text number {i}", "o") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    got = near_duplicates(docs).collect()
    marks = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert len(got) == len(rows)
    assert [r.component_id for r in got] == plain_classes(marks)
    assert sorted(m for _, m in marks) == sorted(plain_fingerprint(t or "") for _, t, _ in rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        {str(r.component_id) for r in got}
    )
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components(path, StageArea(spark, "test")).collect()
    assert len(roots) == 301 and {r.root for r in roots} == {0}

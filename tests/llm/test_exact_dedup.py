from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa

import hashlib

import pytest

from homologrid.llm import exact_dedup
from homologrid.llm.exact_dedup import ContentTable, ExactDedup

SCHEMA = "doc_id long, text string, content_key string, class string"


def rows_of():
    long = "x" * 50_000
    rows = [(i, f"text {i % 7}", None, str(i)) for i in range(60)]
    rows += [(100, None, "a", None), (101, "", "b", None), (None, "", "c", None)]
    rows += [(102, long, None, "l"), (103, long + "y", None, "m"), (104, long, None, "n")]
    rows += [(200, "twice", None, "t"), (200, "twice", None, "t"), (None, "only null", None, None)]
    return rows


@pytest.mark.parametrize("limit", [1, 600, 64 << 20])
def test_groups_against_brute_force(spark, limit):
    rows = rows_of()
    dedup = ExactDedup(spark.createDataFrame(rows, SCHEMA).repartition(5), table_bytes=limit)
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    got = dedup.members().collect()
    assert len(got) == len(rows)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]


def test_kept_rows_have_all_columns(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    kept = ExactDedup(docs).kept()
    assert kept.columns == docs.columns
    by_text = {r.text or "": r for r in kept.collect()}
    assert len(by_text) == kept.count() == 12
    assert by_text["text 0"]["class"] == "56" and by_text[""].content_key == "b"


def test_empty_table(spark):
    dedup = ExactDedup(spark.createDataFrame([], SCHEMA))
    assert dedup.members().count() == 0 and dedup.kept().count() == 0


def test_equal_hashes_do_not_join_texts():
    table = ContentTable()
    placed = [table.place(7, b"%d" % i, True) for i in range(3000)]
    assert placed == list(range(3000))
    assert [table.place(7, b"%d" % i, False) for i in (5, 2999, 4000)] == [5, 2999, -1]


def test_memory_stays_flat_over_copies_with_ascending_ids(monkeypatch):
    names = {"key": "key", "text": "text", "id": "id", "class": "class", "copies": "copies"}
    monkeypatch.setattr(exact_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    held = []

    def batches(n):
        for start in range(0, n, 1000):
            own = range(start, start + 1000)
            texts = [f"text {i % 400} " + "x" * 2000 for i in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([i % 400 for i in own], pa.int64()), pa.array(texts)],
                names=["id", "key", "text"],
            )
            held.append(pa.total_allocated_bytes())

    run = exact_dedup._collapse(names, ["id"], 32 << 20, "/nowhere")
    out = [b for b in run(batches(60_000)) if b.column("copies").null_count < b.num_rows]
    rows = [r for b in out for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == list(range(59_600, 60_000)) and {r["copies"] for r in rows} == {150}
    # Sixty thousand rows of 2 KB are 120 MB; two batches and the compacted chunks are not.
    assert max(held) - held[0] < 40 << 20


def test_whole_rows_count_against_the_table():
    table = ContentTable()
    table.row_bytes = 5000
    table.place(1, b"abc", True)
    assert table.bytes > 5000

"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole; the tokens' character spans are then joined to the
spans of its fields or sections.  Both are sorted, so the interval join is two binary searches per
document inside the task that encoded it, and nothing is shuffled.

A token that crosses a boundary goes by an explicit rule: ``first`` to the section of its first
character, ``last`` to that of its last one, ``most`` to the section that holds most of its
characters (the earlier one on a tie).  Tokens outside all sections count for section -1.

By default the sections are the lines of the text, each with its newline.

Defined results: null text counts as empty and has no sections and no rows; empty sections have 0
tokens; sections must not overlap and are numbered from 0 in their order; repeated rows stay; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.llm.chunks import chunk_encoder, parts
from homologrid.llm.common import bounded_batches, documents, quoted, text_bytes

VOCABULARY = "byte_bpe_50k.json"
RULES = ("first", "last", "most")
OUTSIDE = -1


def line_bounds(text: str) -> np.ndarray:
    """Starts of all lines and the end of the text; an empty text has no line."""
    if not text:
        return np.zeros(1, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.concatenate(([0], np.flatnonzero(points == 10) + 1))
    return np.append(starts[starts < len(points)], len(points))


def attribute(
    begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str
) -> tuple[np.ndarray, int]:
    """Tokens of each section, and of none; tokens and sections are sorted spans of characters."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}; there are {RULES}")
    if not len(starts):
        return np.zeros(0, np.int64), len(begins)
    at = ends - 1 if rule == "last" else begins
    # A token without characters of its own stands at its place.
    at = np.maximum(at, begins)
    own = np.searchsorted(starts, at, "right") - 1
    if rule == "most":
        # A token may span several sections: compare the share of each in turn.
        crossing = np.flatnonzero((own < 0) | (ends > stops[np.maximum(own, 0)]))
        for token in crossing.tolist():
            first = max(0, int(own[token]))
            last = int(np.searchsorted(starts, ends[token], "left"))
            if last > first:
                shares = np.minimum(ends[token], stops[first:last]) - np.maximum(begins[token], starts[first:last])
                own[token] = first + int(np.argmax(shares)) if shares.max() > 0 else OUTSIDE
        place = np.maximum(own, 0)
        inside = (own >= 0) & (begins < np.maximum(stops[place], starts[place] + 1)) & (ends > starts[place])
    else:
        place = np.maximum(own, 0)
        inside = (own >= 0) & (at < stops[place])
    return np.bincount(own[inside], minlength=len(starts)), int((~inside).sum())


def section_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sections: str | None = None,
    rule: str = "first",
    path: str | None = None,
) -> DataFrame:
    """One row per document and section: ``section, first_char, end_char, n_tokens``.

    ``sections`` names a column of ``array<struct<start:int,end:int>>`` in characters; without it the lines are taken.
    """
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}; there are {RULES}")
    path = path or public_tokenizers.path(VOCABULARY)
    kind = dict(docs.dtypes)[key]
    bounded_batches(docs.sparkSession)
    spans = F.col(quoted(sections)) if sections else F.lit(None).cast("array<struct<start:int,end:int>>")
    thin = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"), spans.alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk_encoder(path, offsets=True)
        for batch in batches:
            ids, given = batch.column("id"), batch.column("spans")
            at = 0
            for texts in parts(text_bytes(batch.column("text"))):
                found, per_text = own.chunks(texts)
                place, rows = 0, []
                for n, raw in zip(per_text.tolist(), texts):
                    begins, ends = _spans(found[place : place + n])
                    place += n
                    if sections:
                        pairs = sorted((s["start"], s["end"]) for s in given[at].as_py() or () if s)
                        starts = np.array([p[0] for p in pairs], np.int64)
                        stops = np.array([p[1] for p in pairs], np.int64)
                    else:
                        bounds = line_bounds(raw.decode())
                        starts, stops = bounds[:-1], bounds[1:]
                    counts, outside = attribute(begins, ends, starts, stops, rule)
                    rows.append((at, np.arange(len(counts)), starts, stops, counts))
                    if outside:
                        rows.append((at, np.array([OUTSIDE]), np.array([-1]), np.array([-1]), np.array([outside])))
                    at += 1
                repeat = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(repeat, pa.int64())),
                        *(pa.array(np.concatenate([r[i] for r in rows]).astype(np.int64)) for i in (1, 2, 3, 4)),
                    ],
                    names=["id", "section", "first_char", "end_char", "n_tokens"],
                )

    return thin.mapInArrow(
        run, f"id {kind}, section long, first_char long, end_char long, n_tokens long"
    ).withColumnRenamed("id", key)


def _spans(chunks: list) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of all tokens of a text, from the spans inside its chunks."""
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter((c[0] for c in chunks), np.int64, len(chunks))
    inner = np.concatenate([c[1] for c in chunks])
    counts = np.fromiter((len(c[1]) for c in chunks), np.int64, len(chunks))
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    return inner[:, 0] + base, inner[:, 1] + base


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_counts(documents(spark, folder))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}

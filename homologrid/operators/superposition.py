"""TM-scores of aligned structure pairs: one shuffle brings a pair's residues together,
small numpy steps fit them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AXES = ("x", "y", "z")


def alpha_carbons(atoms: DataFrame) -> DataFrame:
    """``protid, residue, x, y, z``: the first alpha carbon of every residue."""
    spot = F.struct("line_no", "X", "Y", "Z")
    return (
        atoms.where(F.col("NAME") == "CA")
        .groupBy("protid", "CHAIN", "RESNUM")
        .agg(F.min(spot).alias("a"))
        .select(
            "protid",
            F.struct("CHAIN", "RESNUM").alias("residue"),
            F.col("a.X").alias("x"),
            F.col("a.Y").alias("y"),
            F.col("a.Z").alias("z"),
        )
    )


def index_aligned(pairs: DataFrame, carbons: DataFrame) -> DataFrame:
    """Aligned residues of pairs by equal residue identifiers, with the target's length."""
    lengths = carbons.groupBy(F.col("protid").alias("target")).agg(
        F.count(F.lit(1)).alias("length")
    )

    def side(name: str, mark: str) -> DataFrame:
        return carbons.select(
            F.col("protid").alias(name), "residue", *[F.col(a).alias(f"{mark}{a}") for a in _AXES]
        )

    return (
        pairs.select("query", "target")
        .distinct()
        .join(side("query", "q"), "query")
        .join(side("target", "t"), ["target", "residue"])
        .join(lengths, "target")
    )


# A fit ends when the score of a pair grows by less; a fit that never ends is an error.
TOLERANCE = 1e-6
MOST_STEPS = 10_000
# Shares of the aligned residues that a start covers, and its shortest length.
START_SHARES = (1.0, 0.5, 0.25)
SHORTEST_START = 4


def _shares(q: np.ndarray, t: np.ndarray, weights: np.ndarray, scale: float) -> np.ndarray:
    """Per row of ``weights``, the residues' shares in the score after its best superposition."""
    total = weights.sum(axis=1)[:, None]
    q_mean, t_mean = weights @ q / total, weights @ t / total
    own, other = q[None] - q_mean[:, None], t[None] - t_mean[:, None]
    u, _, vt = np.linalg.svd(np.einsum("sn,sni,snj->sij", weights, own, other))
    u[:, :, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))[:, None]
    distances = ((own @ (u @ vt) - other) ** 2).sum(axis=2)
    return 1 / (1 + distances / scale**2)


def start_windows(n: int) -> list[tuple[int, int]]:
    """First residue and length of every start over ``n`` aligned residues."""
    starts = set()
    for share in START_SHARES:
        size = max(min(n, SHORTEST_START), int(n * share))
        starts |= {(first, size) for first in (*range(0, n - size + 1, max(1, size // 2)), n - size)}
    return sorted(starts)


def best_score(q: np.ndarray, t: np.ndarray, length: int) -> float:
    """Score of aligned residues over a target of ``length``: the best of all starts.

    Starts are the whole alignment and its halves and quarters, each overlapping the next.
    From each, residues are weighed by their shares until nothing is gained.
    """
    scale = max(0.5, 1.24 * max(length - 15, 0) ** (1 / 3) - 1.8)
    n = len(q)
    places = np.arange(n)
    weights = np.array([(places >= f) & (places < f + size) for f, size in start_windows(n)], float)
    found, best = 0.0, np.full(len(weights), -1.0)
    for _ in range(MOST_STEPS):
        shares = _shares(q, t, weights, scale)
        scores = shares.sum(axis=1)
        found = max(found, float(scores.max()))
        going = scores > best + TOLERANCE
        if not going.any():
            return found / length
        best, weights = scores[going], shares[going] ** 2
    raise RuntimeError("a superposition did not converge")


def _pair_score(key: tuple, rows: pa.Table) -> pa.Table:
    # In the order of the residues, whatever order the shuffle brought them in.
    residues = [str(r) for r in rows["residue"].to_pylist()]
    order = sorted(range(len(residues)), key=lambda i: (len(residues[i]), residues[i]))
    q, t = (np.stack([rows[f"{s}{a}"].to_numpy() for a in _AXES], axis=1)[order] for s in "qt")
    score = best_score(q, t, rows["length"][0].as_py())
    return pa.table({"query": [key[0].as_py()], "target": [key[1].as_py()], "score": [score]})


def tm_scores(aligned: DataFrame) -> DataFrame:
    """``query, target, score`` of aligned residues, per target length.

    A pair's residues, at most the length of a protein, meet in one task, which runs every
    start to convergence; pairs are spread over all tasks by one shuffle.
    """
    kinds = {name: aligned.schema[name].dataType.simpleString() for name in ("query", "target")}
    return aligned.groupBy("query", "target").applyInArrow(
        _pair_score, f"query {kinds['query']}, target {kinds['target']}, score double"
    )

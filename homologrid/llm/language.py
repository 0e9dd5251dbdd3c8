"""Language identification by hierarchical discrimination.

A text is a vector of hashed byte n-gram shares.  A first group of linear support vector
machines (one per family, against the others) decides the language family; inside
the family one-versus-one machines vote between its languages.  A family of one language
needs no second step.

Training takes a documented, bounded sample: per learned language the ``PER_LANGUAGE``
rows with the smallest hash of their id, among labelled rows outside the held-out third.
The machines are fitted on the driver by dual coordinate descent over these rows; they are a
few weight vectors of ``DIMENSIONS`` floats each.  Scoring is one pass over the table
without a shuffle and covers whole texts.  Only the text is an input of a prediction.

Families come from a table of language codes; a code that it lacks is a family of its own.

Defined results: null text or text without letters is ``und`` with score 0; with nothing to
learn from everything is ``und``; a null id is not held out; repeated rows stay; an empty table
gives an empty table; further columns of any name and type are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.common import bounded_batches, documents, extended, free_names, quoted

UNDETERMINED = "und"
DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3)
PER_LANGUAGE = 400
# Parts of a language whose smallest hashes are found apart.
SAMPLE_SALTS = 256
EPOCHS = 12
COST = 1.0
# Bytes of a text counted at once; whole texts are covered, piece by piece.
PIECE = 1 << 20

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh",
    "austronesian": "id ms tl jv mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], f"only {language}")


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of the lower-cased text."""
    counts = np.zeros(DIMENSIONS, np.int64)
    top = max(GRAMS)
    for start in range(0, max(1, len(text)), PIECE):
        # Pieces overlap, so that n-grams across their bounds count once.
        data = np.frombuffer(text[start : start + PIECE + top - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            m = min(PIECE, len(data) - n + 1)
            if m <= 0:
                continue
            code = np.full(m, n, np.uint32)
            for i in range(n):
                code = code << np.uint32(8) | data[i : i + m]
            hashed = (code * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed, minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def prepared(text: str) -> bytes:
    """Lower-cased words between single spaces."""
    return f" {' '.join(text.lower().split())} ".encode()


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_machine(rows: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge, dual coordinates).

    Both sides weigh alike, whatever their numbers of rows.
    """
    wide = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float64)
    cost = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum()))
    slack = 1 / (2 * COST * cost * len(rows))
    norms = (wide**2).sum(1) + slack
    weights, alpha = np.zeros(wide.shape[1]), np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            gap = 1 - side[i] * (wide[i] @ weights) - slack[i] * alpha[i]
            now = max(0.0, alpha[i] + gap / norms[i])
            weights += (now - alpha[i]) * side[i] * wide[i]
            alpha[i] = now
    return weights


class Model:
    """Families, their machines, and the machines of each pair of languages of a family."""

    def __init__(self, rows: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        self.families = sorted({family_of(x) for x in self.languages})
        own = np.array(languages)
        kind = np.array([family_of(x) for x in languages])
        self.members = {f: [x for x in self.languages if family_of(x) == f] for f in self.families}
        machines = []
        if len(self.families) > 1:
            for family in self.families:
                machines.append(fit_machine(rows, np.where(kind == family, 1.0, -1.0)))
        self.duels = [
            (a, b)
            for f in self.families
            for i, a in enumerate(self.members[f])
            for b in self.members[f][i + 1 :]
        ]
        for a, b in self.duels:
            chosen = (own == a) | (own == b)
            machines.append(fit_machine(rows[chosen], np.where(own[chosen] == a, 1.0, -1.0)))
        self.weights = np.array(machines, np.float32).reshape(len(machines), DIMENSIONS + 1)

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1: the family's share times the share in its duels."""
        margins = self.weights[:, :-1] @ vector + self.weights[:, -1]
        score = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            own = margins[: len(self.families)]
            best = int(np.argmax(own))
            family = self.families[best]
            score = _logistic(float(own[best]))
        members = self.members[family]
        if len(members) == 1:
            return members[0], score
        first = len(self.families) if len(self.families) > 1 else 0
        wins = dict.fromkeys(members, 0.0)
        trust = dict.fromkeys(members, 0.0)
        for (a, b), margin in zip(self.duels, margins[first:].tolist()):
            if a in wins:
                wins[a if margin >= 0 else b] += 1
                trust[a] += _logistic(margin)
                trust[b] += _logistic(-margin)
        best = max(members, key=lambda x: (wins[x], trust[x]))
        return best, score * trust[best] / (len(members) - 1)


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -20, 20))))


def held_out(key: str = "doc_id"):
    """Whether the CRC-32 of the id as text leaves 1 modulo 3; false for a null id."""
    mark = F.pmod(F.crc32(F.col(quoted(key)).cast("string").cast("binary")), F.lit(3))
    return F.coalesce(mark == 1, F.lit(False))


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model | None:
    """A model from at most ``per_language`` rows of each language; None without any."""
    bounded_batches(docs.sparkSession)
    labelled = docs.select(
        F.col(quoted(key)).alias("id"),
        F.col(quoted(language)).alias("label"),
        F.col(quoted(text)).alias("text"),
    ).where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    # The smallest hashes: partial aggregates of bounded size, then their rows.
    order = F.xxhash64("id", F.length("text"))
    chosen = _smallest(labelled.select("label", order.alias("order")), per_language)
    sample = labelled.withColumn("order", order).join(
        F.broadcast(chosen), ["label", "order"], "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                (label, order, features(prepared(t)).tobytes())
                for label, order, t in zip(*(batch.column(c).to_pylist() for c in ("label", "order", "text")))
                if has_letters(t)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in kept], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))],
                names=["label", "order", "features"],
            )

    rows = (
        sample.select("label", "order", "text")
        .mapInArrow(run, "label string, order long, features binary")
        .dropDuplicates(["label", "order"])
        .toPandas()
        .sort_values(["label", "order", "features"])
        .groupby("label")
        .head(per_language)
    )
    if rows.empty:
        return None
    return Model(np.array([np.frombuffer(x, np.float32) for x in rows["features"]]), rows["label"].tolist())


def _smallest(marked: DataFrame, most: int) -> DataFrame:
    """The ``most`` smallest orders of every label.

    First of every label and salt, so a label of any size spreads over tasks, then of the label.
    """
    salted = Window.partitionBy("label", "salt").orderBy("order")
    by = Window.partitionBy("label").orderBy("order")
    return (
        marked.withColumn("salt", F.pmod("order", F.lit(SAMPLE_SALTS)))
        .withColumn("place", F.row_number().over(salted))
        .where(F.col("place") <= most)
        .withColumn("place", F.row_number().over(by))
        .where(F.col("place") <= most)
        .select("label", "order")
        .distinct()
    )


def with_language(docs: DataFrame, model: Model | None, text: str = "text", into=("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score; taken names get an underscore."""
    columns = docs.columns
    into = free_names(columns, *into)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                model.predict(features(prepared(t))) if model and has_letters(t) else (UNDETERMINED, 0.0)
                for t in batch.column(text).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*columns, *into],
            )

    return docs.mapInArrow(run, extended(docs.schema, f"{quoted(into[0])} string, {quoted(into[1])} double"))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a determined language, with their own columns."""
    names = free_names(docs.columns, "lang_pred", "score")
    return (
        with_language(docs, train(docs), into=tuple(names))
        .where(F.col(names[0]) != UNDETERMINED)
        .select(*[F.col(quoted(c)) for c in docs.columns])
    )


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return with_language(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}

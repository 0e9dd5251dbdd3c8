"""Structure quality: origin scoring, confidence, chains - one pass over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homologrid.functions.scaling import structure_confidence
from homologrid.sources.structures import fixed_width, is_atom
from homologrid.schemas import ATOM_FIELDS

# Texts that reveal where a structure comes from, and the body of a
# failed download.
PREDICTED_A = "ALPHAFOLD"
PREDICTED_B = "ESMFOLD"
ARCHIVE = "PDB"
ARCHIVE_REMARK = "RCSB"
ERROR_BODY = "<Error>"


def origin_scores(
    mentions: dict[str, Column], title: dict[str, Column], remark: dict[str, Column], archive_ref: Column
) -> dict[str, Column]:
    """Scores of the four origins from 0/1 flags.

    A title or a remark counts for the first origin it mentions, in the order
    predicted A, predicted B, archive.
    """
    title_b = title[PREDICTED_B] * (1 - title[PREDICTED_A])
    remark_b = remark[PREDICTED_B] * (1 - remark[PREDICTED_A])
    remark_archive = (
        remark[ARCHIVE_REMARK] * (1 - remark[PREDICTED_A]) * (1 - remark[PREDICTED_B])
    )
    score_a = mentions[PREDICTED_A] + title[PREDICTED_A] + remark[PREDICTED_A]
    score_b = mentions[PREDICTED_B] + title_b + remark_b
    score_archive = mentions[ARCHIVE] + archive_ref + remark_archive
    return {
        "AlphaFold": score_a,
        "ESMFold": score_b,
        "PDB": score_archive,
        "Other": F.lit(3) - score_a - score_b - score_archive,
    }


def best_origin(scores: dict[str, Column]) -> Column:
    """Highest score; among equals the name that sorts last."""
    ranked = F.array(
        *[F.struct(score.alias("score"), F.lit(name).alias("name")) for name, score in scores.items()]
    )
    return F.array_max(ranked)["name"]


def _seen(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def assess_structures(lines: DataFrame) -> DataFrame:
    """``protid, pdb_origin, pdb_confidence, pdb_chains`` of every valid structure.

    One scan and one wide shuffle: lines fold to one row per (structure, chain)
    before they move, and those few rows fold to one per structure.
    """
    line = F.col("line")
    atom = is_atom(line)
    first, last = ATOM_FIELDS["CHAIN"]
    temp = fixed_width(line, *ATOM_FIELDS["TEMP"])
    typed = lines.select(
        "protid",
        "line_no",
        "line",
        F.upper(line).alias("upper"),
        atom.alias("atom"),
        F.when(atom, fixed_width(line, first, last)).alias("chain"),
        F.when(atom, temp.try_cast("double")).alias("temp"),
    )
    upper = F.col("upper")
    words = {"a": PREDICTED_A, "b": PREDICTED_B, "p": ARCHIVE, "r": ARCHIVE_REMARK}
    in_title, in_remark = line.contains("TITLE"), line.contains("REMARK")
    reference = F.when(
        F.substring(line, 1, 6).contains("DBREF"),
        F.get(F.split(F.trim(line), r"\s+"), F.lit(5)) == ARCHIVE,
    ).otherwise(False)
    flags = {
        **{f"m_{w}": upper.contains(words[w]) for w in "abp"},
        **{f"t_{w}": in_title & upper.contains(words[w]) for w in "ab"},
        **{f"r_{w}": in_remark & upper.contains(words[w]) for w in "abr"},
        "ref": reference,
        "error": line.contains(ERROR_BODY),
    }
    per_chain = typed.groupBy("protid", "atom", "chain").agg(
        *[_seen(flag).alias(name) for name, flag in flags.items()],
        F.sum("temp").alias("total"),
        F.count("temp").alias("n"),
        F.max("temp").alias("high"),
        F.min("line_no").alias("line_no"),
    )
    seen_chain = F.when(F.col("atom"), F.struct("line_no", "chain"))
    facts = per_chain.groupBy("protid").agg(
        *[_seen(F.col(name)).cast("int").alias(name) for name in flags],
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean"),
        F.max("high").alias("high"),
        F.array_sort(F.collect_list(seen_chain)).alias("chains"),
    )
    scores = origin_scores(
        {PREDICTED_A: F.col("m_a"), PREDICTED_B: F.col("m_b"), ARCHIVE: F.col("m_p")},
        {PREDICTED_A: F.col("t_a"), PREDICTED_B: F.col("t_b")},
        {PREDICTED_A: F.col("r_a"), PREDICTED_B: F.col("r_b"), ARCHIVE_REMARK: F.col("r_r")},
        F.col("ref"),
    )
    return (
        facts.where(F.col("error") == 0)
        .withColumn("pdb_origin", best_origin(scores))
        .select(
            "protid",
            "pdb_origin",
            structure_confidence(F.col("pdb_origin"), F.col("mean"), F.col("high")).alias(
                "pdb_confidence"
            ),
            F.col("chains.chain").alias("pdb_chains"),
        )
    )

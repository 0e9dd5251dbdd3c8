"""Explicit schemas of the text formats this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the structure-search hit table (21 columns).
STRUCTURE_HITS = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("fident", T.DoubleType()),
        T.StructField("alnlen", T.IntegerType()),
        T.StructField("mismatch", T.IntegerType()),
        T.StructField("gapopen", T.IntegerType()),
        T.StructField("qstart", T.IntegerType()),
        T.StructField("qend", T.IntegerType()),
        T.StructField("tstart", T.IntegerType()),
        T.StructField("tend", T.IntegerType()),
        T.StructField("prob", T.DoubleType()),
        T.StructField("evalue", T.DoubleType()),
        T.StructField("bits", T.DoubleType()),
        T.StructField("qcov", T.DoubleType()),
        T.StructField("tcov", T.DoubleType()),
        T.StructField("qlan", T.StringType()),
        T.StructField("taln", T.StringType()),
        T.StructField("coord", T.StringType()),
        T.StructField("tseq", T.StringType()),
        T.StructField("taxid", T.StringType()),
        T.StructField("taxname", T.StringType()),
    ]
)

# Column names and order of the sequence-search hit table (17 columns).
SEQUENCE_HITS = T.StructType(
    [
        T.StructField("qseqid", T.StringType()),
        T.StructField("sseqid", T.StringType()),
        T.StructField("pident", T.DoubleType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("mismatch", T.IntegerType()),
        T.StructField("gapopen", T.IntegerType()),
        T.StructField("qstart", T.IntegerType()),
        T.StructField("qend", T.IntegerType()),
        T.StructField("sstart", T.IntegerType()),
        T.StructField("send", T.IntegerType()),
        T.StructField("evalue", T.DoubleType()),
        T.StructField("bitscore", T.DoubleType()),
        T.StructField("sacc", T.StringType()),
        T.StructField("saccver", T.StringType()),
        T.StructField("sgi", T.StringType()),
        T.StructField("staxids", T.StringType()),
        T.StructField("scomnames", T.StringType()),
    ]
)

CLUSTER_MEMBERS = T.StructType(
    [T.StructField("ClusterRep", T.StringType()), T.StructField("protid", T.StringType())]
)

ID_MAPPING = T.StructType(
    [T.StructField("from", T.StringType()), T.StructField("to", T.StringType())]
)

# Cells that count as missing when a text table is read.
MISSING_CELLS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Half-open, 0-based character ranges of an ATOM line.
ATOM_FIELDS = {
    "ATOM": (0, 6),
    "SERIAL": (6, 11),
    "NAME": (12, 16),
    "ALTLOC": (16, 17),
    "RESIDUE": (17, 20),
    "CHAIN": (21, 22),
    "RESNUM": (22, 26),
    "RESINS": (26, 27),
    "X": (30, 38),
    "Y": (38, 45),
    "Z": (46, 54),
    "OCC": (54, 60),
    "TEMP": (60, 66),
    "SEG": (72, 76),
    "ELEM": (76, 78),
    "CHARGE": (78, 80),
}
ATOM_INTEGERS = ("SERIAL", "RESNUM")
ATOM_DOUBLES = ("X", "Y", "Z", "OCC", "TEMP")

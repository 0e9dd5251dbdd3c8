"""Incremental hit ingestion: new files in, each accession appended once.

The resume file of a batch run (what has been fetched stays fetched) as a stream:
a file source finds new hit files, every micro-batch keeps the accessions the
result table does not hold yet and appends them.  The checkpoint lies beside the result
table, so the numbers of batches always belong to its partitions, and a replayed batch
appends nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from homologrid.operators.hits import HIT_EVALUE, model_hits, pending_ids
from homologrid.schemas import STRUCTURE_HITS
from homologrid.sources.tabular import text_cells, typed_cells

PART_OF_BATCH = "batch"


def stream_structure_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Structure-search hit files of a folder, as they arrive, read like those of a batch."""
    return typed_cells(text_cells(spark.readStream, STRUCTURE_HITS).csv(folder), STRUCTURE_HITS)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    return spark.read.schema(f"protid string, evalue double, {PART_OF_BATCH} bigint").parquet(path)


def append_new(batch: DataFrame, number: int, path: str) -> None:
    """Append the accessions of a micro-batch that no earlier batch has brought.

    The batch writes its own partition and overwrites only that one, so running
    it again after a failure leaves the same table.
    """
    spark = batch.sparkSession
    best = batch.groupBy("protid").agg(F.min("evalue").alias("evalue"))
    stored = _stored(spark, path)
    if stored is not None:
        earlier = stored.where(F.col(PART_OF_BATCH) < number)
        best = best.join(pending_ids(best, earlier), "protid", "left_semi")
    (
        best.withColumn(PART_OF_BATCH, F.lit(number).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PART_OF_BATCH)
        .parquet(path)
    )


def start_ingestion(
    hits: DataFrame, path: str, max_evalue: float = HIT_EVALUE
) -> StreamingQuery:
    """Run over all files present (and no longer), then stop; call again for new files."""
    kept = model_hits(hits.where(F.col("evalue") < max_evalue)).select("protid", "evalue")
    return (
        kept.writeStream.foreachBatch(lambda batch, number: append_new(batch, number, path))
        .option("checkpointLocation", f"{path.rstrip('/')}.checkpoint")
        .trigger(availableNow=True)
        .start()
    )

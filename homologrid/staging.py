"""Written stage tables: lineage cuts and resume points in shared storage.

Iterative operators (communities, set cover, layouts) must not let the plan
grow with every round and must survive the loss of any executor.  Each round is
therefore written as Parquet below the folder named by ``spark.checkpoint.dir``
and read back; nothing is kept only on an executor's own disk.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# Spark's setting for shuffle files that go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for stage tables.

    ``spark.checkpoint.dir`` decides.  Only a local session without that setting
    (one process, one machine) gets a folder of its own; a cluster without it is
    refused, because a machine-local folder would be lost together with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="homologrid-stages-")
    return _local_folders[context.applicationId]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove one stage table through the Hadoop file system it lives on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Queries that run in here leave no shuffle files behind.

    Otherwise these stay until the driver happens to collect its garbage, and the rounds of a job add up on disk.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class StageArea:
    """A private sub-folder of the shared folder holding the tables of one job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._next = 0
        # Results read their stages lazily, so those go when the driver ends.
        atexit.register(self.clear)

    def clear(self) -> None:
        """Delete every table of this area, if the session can still reach them."""
        if self.spark.sparkContext._jsc is not None:
            # At the end of the driver its JVM may be gone already.
            with contextlib.suppress(Py4JError, OSError):
                drop_path(self.spark, self.root)

    def write(self, df: DataFrame, label: str = "stage", **options) -> DataFrame:
        """Write ``df`` once, with the writer's ``options``, and return a scan of what was written."""
        path = f"{self.root}/{self._next:04d}-{label}"
        self._next += 1
        with shuffles_cleaned(self.spark):
            df.write.mode("error").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def forget(self, df: DataFrame | None) -> None:
        """Delete a stage that a later one has replaced."""
        path = getattr(df, "_stage_path", None)
        if path is not None:
            drop_path(self.spark, path)


class ResumableStages:
    """Named stages of a run; a stage written completely is not computed again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def is_done(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        fs = marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(marker))

    def run(self, name: str, build, *given: object) -> DataFrame:
        """Return stage ``name``, computing it with ``build()`` when it is missing.

        What the stage depends on besides its inputs is ``given``: another value is another stage.
        """
        if given:
            name = f"{name}-{hashlib.sha256(repr(given).encode()).hexdigest()[:16]}"
        if not self.is_done(name):
            build().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Pages can be megabytes each, so batches to Python workers are bounded in bytes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Test tables are single files.
    "spark.siteloom.spreadScans": "true",
    # Call sites per expression cost more than the expressions; turn on when debugging.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_shipped: set[str] = set()  # applications that have the package


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siteloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Only a single-machine session may make its own."""
    context = spark.sparkContext
    shared = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="siteloom-checkpoint-")
        context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write the rows out and go on from the copy, so that a lost executor costs one round
    at most and plans of iterative jobs stay short.

    The copy is a Parquet table in the shared folder: its size is known, so joins with it
    are broadcast exactly when that is small, and only the columns in use are read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


class BucketedTable:
    """A table in the shared folder, in buckets of a key, that rows are added to.
    Joins on the key read it as it lies: they shuffle the other side only. Buckets are ``ordered`` by the key for
    joins that sort; a join that looks for few keys by a hash of them needs no order."""

    def __init__(self, spark: SparkSession, name: str, key: list[str], ordered: bool = True, compression: str = "snappy"):
        self.spark, self.key, self.ordered, self.compression = spark, key, ordered, compression
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(
        self,
        rows: DataFrame,
        distinct: bool = False,
        reduced: Callable[[DataFrame], DataFrame] | None = None,
        dealt: bool = False,
    ) -> None:
        """Add ``rows``, or what ``reduced`` makes of them by grouping on the key. Rows out of a join with this
        table on its key are ``dealt`` already; they may come from the table itself."""
        # Dealt by the buckets first, so that each becomes one file. Equal rows meet in one, so that
        # telling them apart shuffles nothing more, and neither does grouping, which has no half before it.
        rows = rows if dealt else rows.repartition(self.buckets, *self.key)
        rows = rows.distinct() if distinct else rows
        rows = reduced(rows) if reduced else rows
        writer = rows.write.format("parquet").option("compression", self.compression).mode("append").bucketBy(self.buckets, *self.key)
        writer = writer.sortBy(*self.key) if self.ordered else writer
        writer.option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The rows without the table: they outlast ``forget``."""
        return self.spark.read.schema(self.read().schema).parquet(self.path)

    def forget(self) -> None:
        """Take the name out of the catalog; the files stay until the shared folder goes."""
        self.spark.sql(f"drop table if exists {self.name}")


#: Most bytes of a batch to a Python worker, so that long rows do not fill its memory.
BATCH_BYTES = "4m"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the batches that its
    Python steps work on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="siteloom-code-")) / "siteloom.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(package.rglob("*.py")):
            files.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)

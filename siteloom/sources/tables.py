"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: whether scans of costly rows are dealt over all cores.
SPREAD = "spark.siteloom.spreadScans"
#: Tasks per core that rows of costly pages are dealt over.
TASKS_PER_CORE = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan over all cores, if the session asks for it: a single small file is
    one task otherwise, however costly its rows are. Off unless set, so large tables are not
    shuffled."""
    spark = scan.sparkSession
    if spark.conf.get(SPREAD, "false") != "true":
        return scan
    return scan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def deal(rows: DataFrame, *key: str) -> DataFrame:
    """Deal short rows that costly ones are made of, before these are made: a table of a few megabytes is one
    task, however many pages come out of it, and adaptive execution would put its rows together again."""
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, *key)


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, html`` of every page, however large."""
    return spread(table(spark, folder, "pages").select("page_id", "url", "html"), "page_id")

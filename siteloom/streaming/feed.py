"""The same jobs on a growing folder of pages or a log of fetch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.operators.extract import extract_pages
from siteloom.operators.links import with_canonical_url
from siteloom.operators.profile import company_facts, profile_facts
from siteloom.session import cut_lineage
from siteloom.sources import store

PAGE_FEED_SCHEMA = "page_id bigint, url string, html string"


def page_feed(spark: SparkSession, folder: str, files: str = "*.parquet") -> DataFrame:
    return (
        spark.readStream.schema(PAGE_FEED_SCHEMA)
        .option("pathGlobFilter", files)
        .parquet(folder)
    )


def run_to_end(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there, write Parquet, stop. Restarts go on where they stopped."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def extract_feed(pages: DataFrame) -> DataFrame:
    """Stateless: every new page is read once, its fields are appended."""
    return extract_pages(pages)


def first_sightings(pages: DataFrame, time: str, horizon: str) -> DataFrame:
    """Drop a canonical URL seen again within the horizon. State is bounded by it."""
    return (
        with_canonical_url(pages)
        .filter("canonical_url is not null")
        .withWatermark(time, horizon)
        .dropDuplicatesWithinWatermark(["canonical_url"])
    )


def fetch_health(outcomes: DataFrame, time: str, width: str, lateness: str) -> DataFrame:
    """Failure, browser and third-party rates per window. ``outcomes``: the time column,
    ``fetched_ok``, ``rendered_with``, ``is_third_party``."""

    def rate(flag):
        return F.round(F.avg(flag.cast("int")), 6)

    source = outcomes.withWatermark(time, lateness) if outcomes.isStreaming else outcomes
    return source.groupBy(F.window(time, width)).agg(
        F.count("*").alias("fetches"),
        rate(~F.col("fetched_ok")).alias("failed_rate"),
        rate(F.col("rendered_with") == "dynamic").alias("dynamic_rate"),
        rate(F.col("is_third_party")).alias("third_party_rate"),
    )


def refresh_profiles(
    extracted: DataFrame, extract_path: str, facts_path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the facts of all sites up to date with a stream of page fields (``site``, ``seq``,
    ``url``, ...). Of every page the newest version counts, so what a page no longer says goes.

    Facts without a ``field`` are to be skipped. Both tables are partitioned by site; a batch reads and rewrites the partitions that it touches.
    A batch that is run again comes to the same result."""

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        # Pages are read once: the rows merged come back from where they were written.
        merged = store.merge_table(extract_path, new, ["site", "url"], "batch")
        touched = cut_lineage(merged.select("site", store.PART).distinct())
        pages = store.touched_parts(spark.read.parquet(extract_path), touched)
        facts = store.with_part(company_facts(profile_facts(pages)), "website")
        # A row without a field in every partition, so that one left without facts is replaced too.
        marks = touched.select(store.PART).distinct()
        facts = facts.unionByName(marks, allowMissingColumns=True)
        store.replace_parts(facts_path, cut_lineage(facts))

    query = (
        extracted.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def merge_to_end(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Run a stream of updated rows to its end and keep the last of each key, so that windows still
    open are part of the table too."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.merge_table(path, batch.withColumn("batch", F.lit(batch_id)), keys, "batch")

    query = (
        stream.writeStream.foreachBatch(merge)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

"""Tables that hold the latest state per key, and JSON reports.

Parquet tables cannot be updated in place. A table here is partitioned by a hash of its first key; a
merge rewrites the partitions that its rows fall into and leaves all others alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.operators.report import COMPANY_FIELDS, PAGE_FIELDS
from siteloom.session import cut_lineage

# Not part of the relational page table.
UNSTORED_PAGE_FIELDS = ["final_url", "is_third_party"]
JSON_COLUMNS = [
    "other_locations", "products", "services", "solutions", "industries", "emails", "phones",
    "social_links",
]


def company_rows(reports: DataFrame) -> DataFrame:
    """Relational company rows: list and map columns as JSON text."""
    flat = reports.select("company.*", F.col("run_meta.finished_at").alias("seen_at"))
    return flat.select(
        *[
            (F.to_json(c) if c in JSON_COLUMNS else F.col(c)).alias(c)
            for c in ["website", *[f for f in COMPANY_FIELDS if f != "website"], "seen_at"]
        ]
    )


def page_rows(reports: DataFrame) -> DataFrame:
    flat = reports.select(
        F.col("company.website").alias("website"),
        F.col("run_meta.finished_at").alias("seen_at"),
        F.explode("pages").alias("p"),
    ).select("website", "seen_at", "p.*")
    kept = [f for f in PAGE_FIELDS if f not in UNSTORED_PAGE_FIELDS]
    return flat.select("website", *kept, "seen_at")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union of both, one row per key: the one with the greatest ``version``; on a tie the
    one from ``new``. Rows of ``old`` without a successor stay."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(version, "_batch")).alias("r"))
        .select(*keys, "r.*")
        .select(*old.columns)
    )


def upsert_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest_wins(old, new, ["website"], "seen_at")


def replace_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest_wins(old, new, ["website", "url"], "seen_at")


# --- partitioned tables -----------------------------------------------------------------

PART = "part"
#: Partitions of a table; a merge rewrites those it touches.
PARTS = 64


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` without its partition column; None before the first merge."""
    stored = _stored(spark, path)
    return None if stored is None else stored.drop(PART)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def replace_parts(path: str, rows: DataFrame) -> None:
    """Write ``rows`` (with ``part``) over the partitions they have. Rows of one partition come together first, large
    partitions in several pieces: every task would else leave a file in each of them."""
    (
        rows.hint("rebalance", PART)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PART)
        .parquet(path)
    )


def touched_parts(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``stored`` in partitions that ``rows`` have; at most ``PARTS`` numbers."""
    parts = [r[0] for r in rows.select(PART).distinct().collect()]
    return stored.filter(F.col(PART).isin(parts))


def with_part(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))


def merge_table(path: str, new: DataFrame, keys: list[str], version: str = "seen_at") -> DataFrame:
    """Merge ``new`` into the table at ``path``, latest wins; the first merge creates it. Returns ``new`` as it was
    written aside, with its partitions."""
    new = cut_lineage(with_part(new, keys[0]))
    stored = _stored(new.sparkSession, path)
    merged = new
    if stored is not None:
        old = touched_parts(stored, new)
        # Written aside first, as a partition cannot be read while it is replaced.
        merged = cut_lineage(latest_wins(old, new, [*keys, PART], version))
    replace_parts(path, merged)
    return new


# --- JSON -----------------------------------------------------------------------------

_TEXTS = T.ArrayType(T.StringType())
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("input_url", T.StringType()),
        T.StructField(
            "run_meta",
            T.StructType(
                [
                    T.StructField("started_at", T.StringType()),
                    T.StructField("finished_at", T.StringType()),
                    T.StructField("pages_discovered", T.LongType()),
                    T.StructField("pages_fetched_ok", T.LongType()),
                    T.StructField("pages_failed", T.LongType()),
                    T.StructField("max_pages_limit", T.LongType()),
                    T.StructField("stop_reason", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "company",
            T.StructType(
                [
                    T.StructField("company_name", T.StringType()),
                    T.StructField("website", T.StringType()),
                    T.StructField("description", T.StringType()),
                    T.StructField("headquarters", T.StringType()),
                    *[T.StructField(f, _TEXTS) for f in COMPANY_FIELDS if f in JSON_COLUMNS[:-1]],
                    T.StructField("social_links", T.MapType(T.StringType(), T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            f,
                            {
                                "http_status": T.IntegerType(),
                                "depth": T.IntegerType(),
                                "fetched_ok": T.BooleanType(),
                                "is_third_party": T.BooleanType(),
                            }.get(f, T.StringType()),
                        )
                        for f in PAGE_FIELDS
                    ]
                )
            ),
        ),
    ]
)


def write_reports(reports: DataFrame, path: str, parts: int = PARTS) -> None:
    """Nested JSON, one line per site, nulls kept, in folders by a hash of the start URL."""
    (
        reports.withColumn(PART, F.pmod(F.xxhash64("input_url"), F.lit(parts)))
        .drop("site")
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .partitionBy(PART)
        .json(path)
    )


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Reports written here (one per line), or pretty-printed files (``multi_line``)."""
    return (
        spark.read.schema(REPORT_SCHEMA)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", multi_line)
        .json(path)
    )


# --- reports of several shapes -------------------------------------------------------------


def _field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _any_texts(v: Column, path: str) -> Column:
    """A list of texts; a single text is a list of one."""
    one = _field(v, path, "string")
    return F.coalesce(_field(v, path, "array<string>"), F.when(one.isNotNull(), F.array(one)))


def _any_links(v: Column, path: str) -> Column:
    """A map of texts, or a list of pairs as objects with ``platform`` and ``url``."""
    pairs = _field(v, path, "array<struct<platform:string,url:string>>")
    told = F.filter(pairs, lambda p: p["platform"].isNotNull())
    return F.coalesce(_field(v, path, "map<string,string>"), F.map_from_entries(told))


def _fields_of(v: Column, kind: T.StructType, at: str = "$") -> list[Column]:
    return [_field(v, f"{at}.{f.name}", f.dataType.simpleString()).alias(f.name) for f in kind]


def read_any_reports(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reports as ``read_reports`` gives them, whatever their shape, and what could not be read.

    Each record (a line, with ``multi_line`` a file) is read as a variant, and its fields are taken where their
    values can be cast. The facts of the run may stand in any object whose name ends in ``_meta``, or beside the
    start URL; lists may be single texts, links to social sites a list of objects; fields that are missing are null.
    The second table has a row per record that is no report: ``file, record, reason``."""
    texts = spark.read.text(path, wholetext=multi_line, recursiveFileLookup=multi_line)
    records = texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
    v = F.col("v")
    told = records.filter(F.trim("record") != "").withColumn("v", F.try_parse_json("record")).withColumn(
        "fields", _field(v, "$", "map<string,variant>")
    )
    reason = (
        F.when(v.isNull(), "not_json")
        .when(F.col("fields").isNull(), "not_an_object")
        .when(_field(v, "$.input_url", "string").isNull(), "no_input_url")
        .when(F.col("fields")["company"].isNull() & F.col("fields")["pages"].isNull(), "no_company_and_no_pages")
    )
    judged = told.withColumn("reason", reason)
    names = F.filter(F.map_keys("fields"), lambda n: n.endswith("_meta"))
    kinds = {f.name: f.dataType for f in REPORT_SCHEMA}
    found = judged.filter("reason is null").withColumn(
        "run", F.coalesce(F.get(F.transform(names, lambda n: F.col("fields")[n]), F.lit(0)), v)
    )
    company = [
        (_any_links if isinstance(f.dataType, T.MapType) else _any_texts)(v, f"$.company.{f.name}").alias(f.name)
        if isinstance(f.dataType, (T.MapType, T.ArrayType))
        else _field(v, f"$.company.{f.name}", "string").alias(f.name)
        for f in kinds["company"]
    ]
    page = kinds["pages"].elementType
    pages = F.transform(_field(v, "$.pages", "array<variant>"), lambda p: F.struct(*_fields_of(p, page)))
    reports = found.select(
        _field(v, "$.input_url", "string").alias("input_url"),
        F.struct(*_fields_of(F.col("run"), kinds["run_meta"])).alias("run_meta"),
        F.when(_field(v, "$.company", "map<string,variant>").isNotNull(), F.struct(*company)).alias("company"),
        pages.alias("pages"),
    )
    return reports, judged.filter("reason is not null").select("file", "record", "reason")

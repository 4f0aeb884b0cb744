"""The registered queries of this subpackage, by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import bpe, centroids, jaccard, knn, langid, licenses, mixing, packing, quality, quotes
from siteloom.llm import resampling, sharding, urlfilter
from siteloom.session import ship_package
from siteloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


@query
def op1_quality_rules(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.fit_model(docs, table(spark, folder, "labels"))
    return quality.judge(docs.select("doc_id", "text"), model, ["doc_id"])


@query
def op2_best_fit_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER)


@query
def op3_quotation_linking(spark, folder):
    return quotes.reply_ordered(table(spark, folder, "conversations"))


def _fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def training_fold(docs: DataFrame) -> DataFrame:
    """Rows to learn languages from; rows without an id are in neither fold."""
    return docs.filter(_fold() != 0)


def language_profiles(docs: DataFrame) -> langid.Profiles:
    """Profiles of the training fold."""
    return langid.learn(training_fold(docs))


@query
def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    marked = docs.select("doc_id", "text", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"))
    return langid.identify(marked, language_profiles(docs), ["doc_id", "held_out"])


@query
def op5_topk_search(spark, folder):
    return knn.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op6_mixing(spark, folder):
    docs = mixing.with_tokens(table(spark, folder, "documents")).withColumn(
        "topic", mixing.topic_of("text")
    )
    rows = mixing.mixed(docs.select("doc_id", "source", "lang", "topic", "n_tokens"))
    return rows.withColumn("probability", F.round("probability", 6))


@query
def op7_sharding(spark, folder):
    return sharding.sharded(table(spark, folder, "documents").select("doc_id", "text"), 24)


@query
def op8_url_filter(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, urlfilter.default_model(spark), urlfilter.RULES)
    return judged.withColumn("block_score", F.round("block_score", 4))


@query
def op9_jaccard_join(spark, folder):
    return jaccard.jaccard_components(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op10_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op11_bpe_encoding(spark, folder):
    docs = table(spark, folder, "documents")
    ids = bpe.encode(docs, BYTE_TOKENIZER, carry=["doc_id"])
    both = bpe.decode(ids, BYTE_TOKENIZER, text="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op12_centroid_clustering(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"), 64)


@query
def op13_importance_resampling(spark, folder):
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

"""The training-data pipeline: quality, line dedup, near-duplicate documents, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and rereads for the next.
All but the last return the columns of their documents, whatever else these hold and whatever it is called. Null, empty
and blank texts are judged like others by the classifier and link with nothing after it; the last stage takes no text
without words. Null and repeated ids are kept. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import quality
from emberlog.llm.decontaminate import drop_contaminated
from emberlog.llm.line_dedup import dedup_lines
from emberlog.llm.mixing import mix
from emberlog.llm.ngram_join import ngram_components
from emberlog.llm.shared import fresh, materialize, ship


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that can be called alone: executors get the package first."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, docs, sf_dir)

    return call


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.7 or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("quality_score", docs)
    return quality.with_score(docs, model, score_col=score).where(F.col(score) >= 0.7).select(docs.columns)


@stage
def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near duplicates of others; those that lose all of their lines go. ``n_chars`` is
    counted anew where lines went."""
    cut = dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text")).where("n_removed = 0 or n_removed < n_lines")
    fewer = F.col("n_removed") > 0
    new = {"text": F.col("text"), "n_chars": F.when(fewer, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return cut.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at a Jaccard similarity of 0.8 or more, the least doc_id;
    one row, whether ids repeat or are null, which count as the greatest."""
    # rows have keys of their own, which hold once they are written
    rows = materialize(docs.select(F.struct("*").alias("row"), "doc_id", "text", F.monotonically_increasing_id().alias("key")), "rows")
    linked = ngram_components(rows, n=5, percent=80, id_col="key").select("key", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "key")
    ranked = linked.join(rows.select("key", order.alias("order")), "key")
    first = ranked.groupBy("component_id").agg(F.min("order")["key"].alias("key"))
    return rows.join(first, "key", "left_semi").select("row.*")


@stage
def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, in which epoch and block, each document is taken, so that source weights reach 98 % of the greatest
    entropy and nothing is taken over a hundred times."""
    return mix(docs, entropy=0.98, most_epochs=100.0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", no_benchmark_text),
    ("mixing sources", mixed_sources),
]

#: The classifier and the fuzzy lines can't be said in SQL; tests hold each stage against a plain version of it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = materialize(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

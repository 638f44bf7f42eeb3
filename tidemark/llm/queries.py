"""Queries p3, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import count_column, encode_column
from tidemark.llm.packing import Limits, pack
from tidemark.llm.quantiles import EPSILON, percentile_table, rank_distances
from tidemark.llm.subjects import assign_subjects, compose_subjects
from tidemark.plans.registry import Registry
from tidemark.session import cut_lineage
from tidemark.sources.tables import table

LLM = Registry()


@LLM.query("p3_percentiles")
def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentile_table(table(spark, sf_dir, "condition_evals"), "eval_id", "asset_key", "timestamp", "eval_duration_us")


@LLM.query(
    "p3_rank_check",
    """WITH v AS (SELECT DISTINCT eval_id, asset_key, timestamp // 86400000000000 AS day, eval_duration_us FROM condition_evals WHERE eval_duration_us >= 0 AND asset_key IS NOT NULL),
g AS (SELECT asset_key, '' AS period, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT asset_key, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d'), count(*) FROM v GROUP BY 1, 2)
SELECT asset_key, period, n, unnest([50, 90, 95, 99]) AS percent, true AS within FROM g""",
)
def p3_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile's true rank, counted over all values, is within the stated share of the ranks."""
    evals = table(spark, sf_dir, "condition_evals")
    answers = cut_lineage(percentile_table(evals, "eval_id", "asset_key", "timestamp", "eval_duration_us"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("timestamp") / F.lit(86_400_000_000_000)).cast("int")), "yyyy-MM-dd")
    each = evals.filter("eval_duration_us >= 0 AND asset_key IS NOT NULL").select("eval_id", "asset_key", "timestamp", F.col("eval_duration_us").alias("value")).distinct()
    values = each.select("asset_key", "value", F.explode(F.array(F.lit(""), day)).alias("period"))
    return rank_distances(answers, values, "asset_key").select("asset_key", "period", "n", "percent", (F.col("distance") <= F.ceil(F.col("n") * EPSILON)).alias("within"))


@LLM.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"))


@LLM.query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_column(table(spark, sf_dir, "documents")), limits=Limits(tokens=2048))


LIMITED = Limits(tokens=2048, documents=12, attention=2_500_000)


@LLM.query("p8_limited")
def p8_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that also hold at most 12 documents and an attention cost of 2.5 million, so pieces of 1,581 tokens at most."""
    return pack(count_column(table(spark, sf_dir, "documents")), limits=LIMITED)


CHARACTERS = Limits(tokens=6_000, documents=10, attention=20_000_000)


@LLM.query(
    "p8_capacity_check",
    f"""WITH d AS (SELECT n_chars, CAST(ceil(n_chars / {CHARACTERS.piece()}.0) AS BIGINT) AS k FROM documents WHERE n_chars > 0)
SELECT CAST(sum(k) AS BIGINT) AS n_pieces, CAST(sum(n_chars) AS BIGINT) AS total, (SELECT count(DISTINCT doc_id) FROM documents WHERE n_chars > 0) AS n_documents,
 CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS too_many, CAST(0 AS BIGINT) AS too_costly, CAST(0 AS BIGINT) AS numbers_left_out FROM d""",
)
def p8_capacity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nothing is lost and no container breaks a limit, with all three binding; sizes in characters, which SQL knows."""
    packed = cut_lineage(pack(table(spark, sf_dir, "documents"), size="n_chars", limits=CHARACTERS))
    size, (most, documents, attention) = F.col("size").cast("long"), CHARACTERS.vector()
    of_container = packed.groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.sum(size * size).alias("cost"))
    limits = of_container.agg(
        F.count_if(F.col("total") > most).alias("too_long"), F.count_if(F.col("n") > documents).alias("too_many"), F.count_if(F.col("cost") > attention).alias("too_costly"),
        (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count(F.lit(1))).alias("numbers_left_out"),
    )
    whole = packed.agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(size).alias("total"), F.count_distinct("doc_id").alias("n_documents"))
    return whole.join(F.broadcast(limits))  # one row each


def corpus(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects")]


# In this corpus a text on nothing but the platform is about software, and every text with words is about something.
OF_THE_PLATFORM = {"fallback": "software", "whole": True}


@LLM.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(*corpus(spark, sf_dir), **OF_THE_PLATFORM).select("doc_id", "subject")


@LLM.query("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject, kind of source and language code; a document of two subjects counts in both."""
    documents, labels, subjects = corpus(spark, sf_dir)
    language = F.coalesce(F.lower(F.regexp_extract("lang", "^[A-Za-z]{2}", 0)), F.lit(""))
    grouped = documents.select("doc_id", "text", F.split("source", ":")[0].alias("source"), language.alias("lang"))
    return compose_subjects(grouped, labels, subjects, ["source", "lang"], **OF_THE_PLATFORM)

"""The operN queries of this subpackage and what SQL can express of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import crf, fertility, language, licenses, lm, mixing, nearjoin, packing, secrets, topk
from tidemark.llm._shared import table


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8(table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(table(spark, sf_dir, "documents"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op7(table(spark, sf_dir, "documents"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.op2(table(spark, sf_dir, "documents"))


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.op1(table(spark, sf_dir, "documents"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op9(table(spark, sf_dir, "documents"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_columnar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op6(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fertility_rules": op1_fertility_rules,
        "op2_chosen_path": op2_chosen_path,
        "op3_vector_packing": op3_vector_packing,
        "op4_pareto_mix": op4_pareto_mix,
        "op5_line_crf": op5_line_crf,
        "op6_columnar_top_k": op6_columnar_top_k,
        "op7_ppm_language": op7_ppm_language,
        "op8_secret_scan": op8_secret_scan,
        "op9_deleted_interpolation": op9_deleted_interpolation,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_columnar_top_k": OP6_SQL,
        "op10_license_scan": licenses.op10_sql(),
    }

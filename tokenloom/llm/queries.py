"""The registered queries of the ten operators and of the pipeline, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, lm_scores, neighbours, packing, simhash, suffix_dedup, token_files, toxicity, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_token_files": token_files.query,
        "op3_best_fit_packing": packing.query,
        "op4_multi_index_neighbours": neighbours.query,
        "op5_decontamination": decontaminate.query,
        "op6_html_text": html_text.query,
        "op7_lm_scores": lm_scores.query,
        "op8_toxicity": toxicity.query,
        "op9_warc": warc.query,
        "op10_simhash": simhash.query,
        "pipeline": pipeline,
    }


#: Largest of equal payloads of 1000 bytes or more is the response; SQL sees the same without any archive.
OP9 = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest
  FROM pages
), g AS (
  SELECT digest, max(page_id) AS top FROM p WHERE size >= 1000 GROUP BY digest
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id < top THEN top END AS refers_to,
       strftime(to_timestamp(1577836800 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM p LEFT JOIN g ON p.digest = g.digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9}

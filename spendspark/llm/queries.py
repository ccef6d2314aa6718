"""Registered queries of the operators: thin views of their outputs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spendspark.llm import (bpe, decontaminate, html_text, jaccard_join, language_id, line_dedup, merkle, periodic_runs, pii,
                            ranked_search, substring_dedup, toxicity, url_filter)
from spendspark.llm.frames import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op2_pii")
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(read(spark, folder, "documents"))


@query("op3_substring_dedup", substring_dedup.SQL)
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.report(read(spark, folder, "documents"))


@query("op4_merkle", merkle.SQL)
def op4_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(read(spark, folder, "documents"))


@query("op5_jaccard_join", jaccard_join.SQL)
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.report(read(spark, folder, "documents"))


@query("op6_line_dedup", line_dedup.SQL)
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(read(spark, folder, "documents"))


@query("op6_line_runs", line_dedup.RUNS_SQL)
def op6_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report_runs(read(spark, folder, "documents"))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query("op8_decontaminate", decontaminate.SQL)
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


# The rules that op9 judges by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP9_SQL = r"""
WITH r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                 ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT u.*, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""


@query("op9_url_filter", OP9_SQL)
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, folder, "pages"), rules)


@query("op10_html_text")
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.report(read(spark, folder, "pages"))


@query("op11_ranked_search", ranked_search.SQL)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op12_periodic_runs", periodic_runs.SQL)
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.report(read(spark, folder, "documents"))


@query("op13_language_id")
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.report(read(spark, folder, "documents"))

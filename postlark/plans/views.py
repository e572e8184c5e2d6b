"""Tables of the posting model made from the star schema: SQL that Spark and the checking engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_companies": """
        SELECT c_custkey AS id, c_name AS name, lower(c_name) AS normalized_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS original_sheet_url,
               c_acctbal >= 0 AS enabled FROM customer""",
    "v_sources": """
        SELECT s_suppkey AS id, s_suppkey AS company_id, CASE s_nationkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'generic_html' ELSE 'jsonld' END AS source_type,
               s_name AS source_url, CASE WHEN s_nationkey % 4 < 2 THEN lower(s_name) END AS external_identifier, s_acctbal >= 0 AS enabled,
               CAST(5 AS INT) AS poll_interval_minutes, CAST(s_nationkey % 5 AS INT) AS consecutive_failures,
               CASE s_suppkey % 3 WHEN 1 THEN TIMESTAMP '2024-01-10 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-20 00:00:00' END AS next_check_at FROM supplier""",
    "v_postings": """
        SELECT o_orderkey AS id, o_custkey AS company_id, o_orderkey % 10 AS career_source_id, concat('job ', CAST(o_orderkey AS STRING)) AS external_job_id,
               concat(o_orderpriority, ' ', c_mktsegment) AS title, lower(concat(o_orderpriority, ' ', c_mktsegment)) AS normalized_title,
               CASE WHEN o_orderkey % 11 <> 0 THEN n_name END AS location_text, CASE WHEN n_nationkey < 5 THEN 'Israel' END AS country, r_name AS region,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status, o_orderdate AS first_seen_at,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS source_published_at, CAST(NULL AS TIMESTAMP) AS archived_at, c_mktsegment AS description,
               CASE o_orderkey % 6 WHEN 0 THEN 'senior' WHEN 1 THEN 'intern' WHEN 2 THEN 'junior' WHEN 3 THEN 'mid' WHEN 4 THEN 'lead' ELSE 'unknown' END AS seniority,
               CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 7 END AS INT) AS experience_min_years, o_totalprice AS price
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_matches": """
        SELECT CAST(1 AS BIGINT) AS candidate_profile_id, CAST(l_linenumber AS BIGINT) AS target_role_id, l_orderkey AS job_id, max(l_quantity) / 50 AS candidate_semantic_score,
               max(l_discount) * 10 AS intent_semantic_score, max(l_tax) / 0.08 AS skill_score, round(max(l_extendedprice) / 1050, 1) AS final_score
        FROM lineitem GROUP BY l_linenumber, l_orderkey""",
    "v_roles": """
        SELECT CAST(p_partkey % 7 + 1 AS BIGINT) AS id, min(p_name) AS canonical_name, CAST(floor(min(p_retailprice) - 899) AS INT) AS max_expected_years, min(p_size) % 2 >= 0 AS enabled
        FROM part GROUP BY p_partkey % 7 + 1""",
    "v_feedback": """
        SELECT event_id AS id, user_id AS job_id, CASE event_type WHEN 'click' THEN 'interested' WHEN 'view' THEN 'saved' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'not_relevant'
               ELSE 'too_senior' END AS action, ts AS created_at FROM events""",
    "v_runs": """
        SELECT event_id AS run_id, user_id % 10 AS source_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status, CAST(floor(value) AS BIGINT) % 2 AS jobs_seen,
               CASE event_type WHEN 'error' THEN props END AS error_type, ts AS started_at FROM events""",
    "v_snapshots": """
        SELECT DISTINCT user_id % 20 AS source_id, concat(event_type, CAST(user_id % 3 AS STRING)) AS external_job_id, CAST(extract(day FROM ts) AS INT) AS crawl_no FROM events""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in TABLES if f" {t} " in f"{text} ".replace("\n", " ")]
    for t in used:
        text = f"{text} ".replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """sql with the views it names before it."""
    named = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in sql]
    if not named:
        return sql
    rest = sql.lstrip()
    return "WITH " + ", ".join(named) + (f", {rest[5:]}" if rest.startswith("WITH ") else f" {rest}")

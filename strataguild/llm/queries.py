"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataguild.llm import decontaminate, html, langid, leaks, licenses, mixing, quality, runs, simhash, substrings, tokens, urls, vectors
from strataguild.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            TWINS[name] = sql
        return run

    return wrap


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op2_url_rules",
    rf"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN regexp_matches(host, '(^|[.-])(adult|bets|casino|porn|spam|xxx)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled""",
)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.SITE_RULES + urls.WORD_RULES, ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        decontaminate.items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "first_hit",
        "longest_run",
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_mix_to_targets")
def op1_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    shares = [F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return found.select("doc_id", "n_tokens", *shares, "rate")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"))


@query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op6_token_ids")
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.store_ids(read(spark, sf_dir, "documents"))


@query("op7_repeats")
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"), texts=False)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256")
    )


def _codes_sql(parts: int = vectors.PARTS, entries: int = vectors.ENTRIES, rounds: int = vectors.ROUNDS) -> str:
    """All rounds written out: assign every part, average, assign again."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST({vectors.SCALE} AS DOUBLE) * x) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"""cut AS MATERIALIZED (SELECT rid, vec_id, label, p,
            list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) t(p))""",
        f"""c0 AS MATERIALIZED (SELECT p, j, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY rid) - 1 AS j FROM cut) WHERE j < {entries})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT rid, p, vec_id, label, x, best % {entries} AS j, best // {entries} AS d FROM (
                SELECT rid, p, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x,
                       min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {entries} + j) AS best
                FROM cut JOIN c{n} USING (p) GROUP BY rid, p))"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT p, j, coalesce(m.c, old.c) AS c FROM c{n} old LEFT JOIN (
                    SELECT p, j, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS c FROM (
                        SELECT p, j, i, sum(x[i]) AS s, count(*) AS k FROM (SELECT p, j, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY p, j, i)
                    GROUP BY p, j) m USING (p, j))"""
            )
    last = f"a{rounds}"
    steps.append(
        f"""coded AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', j), '' ORDER BY p) AS code,
            CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY rid)"""
    )
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM c{rounds}) AS codebooks_sha256 FROM coded"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.code_rows(read(spark, sf_dir, "embeddings"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_rows(read(spark, sf_dir, "documents"))


@query("op13_secrets")
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.secret_rows(read(spark, sf_dir, "documents"))

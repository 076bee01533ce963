"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeo.llm import (
    chat_views,
    decontaminate,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    resampling,
    sharding,
    token_alignment,
    token_counts,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its checking SQL if there is one."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINE_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_WS}), {_AZ}) AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
             GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last_doc AS dropped
           FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query(_LINE_SQL)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SHINGLE_SQL = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[ \\t\\n\\x0b\\f\\r]+') AS ws FROM documents
),
worded AS (SELECT doc_id, [w FOR w IN ws IF w <> ''] AS ws FROM split),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS ss
    FROM worded
),
sized AS (SELECT doc_id, len(ss) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(ss) AS s FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
         FROM tokens a JOIN tokens b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
          WHERE 100 * overlap >= 75 * (x.n + y.n - overlap)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS seen FROM sized UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.seen = e.a)
SELECT doc_id, any_value(n) AS n_shingles, min(seen) AS component_id FROM reached JOIN sized USING (doc_id) GROUP BY doc_id
"""


@query(_SHINGLE_SQL)
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


@query()
def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "source", "block", "slot", "mix_order")


@query()
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

_RULE_ROWS = ", ".join(
    f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in RULES
)
_URL_PARTS = f"""
parts AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0
                 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {_RULE_ROWS})"""


def _level_sql(name: str, groups: str, prior: str, columns: str) -> str:
    """The posterior of one level as SQL; ``groups`` gives the columns, n, k and the prior mean m."""
    s = url_filter
    return f"""
{name}_prior AS (SELECT {columns}, g.n, g.k, {prior} AS m FROM {groups}),
{name}_fit AS (
    SELECT (1 - rho) / rho AS s FROM (
        SELECT coalesce(least(greatest(CASE WHEN room > 0 THEN off / room END, {s.MIN_RHO}::DOUBLE), {s.MAX_RHO}::DOUBLE), {s.MIN_RHO}::DOUBLE) AS rho
        FROM (SELECT sum(n * pow(k / n::DOUBLE - m, 2) - m * (1 - m)) FILTER (WHERE n > 0) AS off,
                     sum((n - 1) * (m * (1 - m))) FILTER (WHERE n > 0) AS room FROM {name}_prior))
),
{name}_level AS (SELECT p.*, s + n AS weight, (s * m + k) / (s + n) AS mean FROM {name}_prior p, {name}_fit)"""


_HOST_NAME = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_URL_SQL = f"""
WITH {_URL_PARTS},
good AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
         FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k
           FROM parts LEFT JOIN good USING (page_id) GROUP BY host),
named AS (SELECT *, {_HOST_NAME} AS name FROM counts),
hosts AS (
    SELECT host, n, k,
        CASE WHEN bare OR domain = '' THEN name ELSE domain END AS domain,
        CASE WHEN bare THEN '' ELSE suffix END AS suffix
    FROM (SELECT *, regexp_matches(name, '^[0-9.]+$|^\\[|^[^.]*$') AS bare,
                 regexp_extract(name, '{url_filter._DOMAIN}', 1) AS domain,
                 regexp_extract(name, '{url_filter._SUFFIX}', 1) AS suffix FROM named)
),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
{_level_sql("suffix", "suffixes g", "(SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE FROM suffixes)", "g.suffix")},
{_level_sql("domain", "domains g JOIN suffix_level p USING (suffix)", "p.mean", "g.domain")},
{_level_sql("host", "hosts g JOIN domain_level p USING (domain)", "p.mean", "g.host")},
judged AS (
    SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
           h.mean - {url_filter.Z} * sqrt(h.mean * (1 - h.mean) / (h.weight + 1)) AS bound,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS rank
    FROM parts p JOIN host_level h USING (host)
    LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN bound >= {url_filter.MIN_GOOD} THEN 'allow' ELSE 'block' END) AS verdict,
       round(bound, 6) AS bound
FROM judged WHERE rank = 1
"""


@query(_URL_SQL)
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    outcomes = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull(), good).alias("good")
    )
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


@query()
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_CHAT_SQL = """
WITH turns AS (
    SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) - 1) // 1024 AS segment FROM (
        SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\\r\\n]', ' ', 'g') AS who,
               replace(coalesce(text, ''), '<|', '< |') AS said
        FROM conversations)
),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM turns WHERE who <> 'system'),
seen AS (
    SELECT t.*, p.perspective, t.who = p.perspective AS own,
        '<|im_start|>' || CASE WHEN t.who = p.perspective THEN 'assistant' WHEN t.who = 'system' THEN t.who
            ELSE 'user name=' || t.who END || chr(10) AS head,
        said || '<|im_end|>' || chr(10) AS body
    FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
placed AS (
    SELECT *, sum(length(head) + length(body)) OVER w AS upto,
           row_number() OVER w AS rn
    FROM seen
    WINDOW w AS (PARTITION BY conv_id, segment, perspective ORDER BY turn NULLS FIRST, who, said ROWS UNBOUNDED PRECEDING)
),
runs AS (
    SELECT *, upto - coalesce(max(CASE WHEN own THEN upto END) OVER (
                  PARTITION BY conv_id, segment, perspective ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS since, count(*) OVER (PARTITION BY conv_id, segment, perspective) AS n
    FROM placed
)
SELECT conv_id, segment, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
       string_agg(head || body, '' ORDER BY rn) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (since - length(body))::BIGINT::VARCHAR || ' ' || length(body)::VARCHAR
                                WHEN rn = n THEN since::BIGINT::VARCHAR END, ' ' ORDER BY rn), '') AS mask_runs
FROM runs GROUP BY conv_id, segment, perspective
"""


@query(_CHAT_SQL)
def op10_chat_views(spark: SparkSession, folder: str) -> DataFrame:
    return chat_views.rotate(table(spark, folder, "conversations"))


@query()
def op11_target_resample(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    drawn = resampling.draw(resampling.weigh(docs, target, keep=["doc_id"]))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pieces(table(spark, folder, "documents"))
    placed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align(table(spark, folder, "documents"))

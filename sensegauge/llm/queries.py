"""The queries of this subpackage, each with its operator's production parameters on the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensegauge.llm import decontaminate, licenses, line_dedup, ngram_join, pieces, quality, secrets, token_counts, toxicity, url_filters
from sensegauge.llm.shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.expr("array_join(transform(spans, s -> concat(s.start, ':', s.stop)), ',')").alias("toxic_spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, percent=90)


#: Dated entries of a list of hosts and paths: key, action, since.
URL_LIST = (
    ("spam-farm.example.com", "block", "2024-01-10"),
    ("spam-farm.example.com", "lift", "2024-06-01"),
    ("spam-farm.example.com", "block", "2024-09-15"),
    ("cheap-pills.example.com", "block", "2024-02-01"),
    ("casino-win.example.com", "block", "2024-03-20"),
    ("m.casino-win.example.com", "allow", "2024-05-05"),
    ("m.casino-win.example.com", "lift", "2024-10-05"),
    ("free-bets.example.com", "block", "2024-01-01"),
    ("free-bets.example.com/de", "allow", "2024-04-01"),
    ("ads-track.example.com", "block", "2024-07-01"),
    ("ads-track.example.com", "allow", "2024-11-11"),
    ("example.net", "block", "2024-08-01"),
    ("example.net", "lift", "2024-08-15"),
    ("blog.tionsh.example.net", "allow", "2024-08-05"),
    ("example.org", "allow", "2024-01-01"),
)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch time: a page counts as fetched on the day of 2024 that its id gives."""
    entries = spark.createDataFrame(URL_LIST, "key string, action string, since string").withColumn("since", F.to_date("since"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    return url_filters.judge(pages, entries).select("page_id", "host", "fetched", "verdict", "rule", "since")


OP4_SQL = f"""
WITH list(key, action, since) AS (VALUES {", ".join(f"('{k}', '{a}', DATE '{d}')" for k, a, d in URL_LIST)}),
spans AS (SELECT key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM list),
captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    lower(regexp_extract(url, '{url_filters.HOST}', 1)) AS host, lower(regexp_extract(url, '{url_filters.SEGMENT}', 1)) AS seg FROM pages),
asked AS (
  SELECT page_id, fetched, 0 AS rank, host || '/' || seg AS key FROM captures WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched, i AS rank, array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, 1 + greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM captures WHERE host <> '')),
best AS (
  SELECT page_id, arg_min(action, rank) AS action, arg_min(asked.key, rank) AS rule, arg_min(since, rank) AS since
  FROM asked JOIN spans ON asked.key = spans.key AND since <= fetched AND (until IS NULL OR fetched < until) AND action <> 'lift' GROUP BY page_id)
SELECT c.page_id, host, fetched, coalesce(action, 'none') AS verdict, rule, since FROM captures c LEFT JOIN best b ON c.page_id = b.page_id
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < sum(r.base for r in secrets.RULES))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no edits: each document gets a replacement, a removal and an insertion at places its length gives."""
    sent = token_counts.ship(spark, token_counts.read_ranks())
    docs = token_counts.build(table(spark, sf_dir, "documents").select("doc_id", "text"), sent)
    n = F.coalesce(F.length("text"), F.lit(0))
    edits = [(F.floor(n / 3), F.floor(n / 3) + 12, F.concat(F.lit(" edited "), F.col("doc_id").cast("string"))), (F.floor(n / 2), F.floor(n / 2) + 40, F.lit("")), (F.floor(2 * n / 3), F.floor(2 * n / 3), F.lit("\n\nAdded line.\n"))]
    listed = F.array(*(F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), t.alias("replacement")) for a, b, t in edits))
    counted = token_counts.edit(docs.withColumn("edits", listed), sent)
    return counted.select("doc_id", "n_before", "n_tokens", "n_chars", "n_edits", F.size("tree").cast("long").alias("n_segments"), "encoded", F.sha2("text", 256).alias("text_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = pieces.ship(spark, pieces.Vocabulary.read())
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), sent, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")).alias("round_trip"), "ids")


def _op6_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    parts = [
        f"""SELECT doc_id, rn, {i} AS ord, '{r.kind}' AS kind, ms, vs, ps, {r.least} AS least FROM (SELECT doc_id, rn, regexp_extract_all(t, '{quoted(r.pattern)}') AS ms,
        regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS vs, string_split_regex(t, '{quoted(r.pattern)}') AS ps FROM docs WHERE regexp_matches(t, '{quoted(r.pattern)}'))"""
        for i, r in enumerate(secrets.RULES)
    ]
    n_base = sum(r.base for r in secrets.RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT rn, ord, kind, ms, vs, ps, least, unnest(range(1, len(ms) + 1)) AS i FROM found),
spans AS (
  SELECT rn, ord, kind, length(ms[i]) AS n, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS start
  FROM each WHERE length(vs[i]) >= least),
texts AS (SELECT rn, ord, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS s FROM spans),
sums AS (
  SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY start, ord) FILTER (ord < {n_base}) AS base, string_agg(s, ',' ORDER BY start, ord) AS spans FROM texts GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (rn)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each document."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("leaks", F.expr("array_join(transform(array_sort(leaks), s -> concat(coalesce(cast(s.item_id as string), 'null'), ':', s.covered, '/', s.item_words)), ',')"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


OP2_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, i - 1 AS i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts)),
lines AS (SELECT * FROM every WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
firsts AS (SELECT l, min((doc_id, i)) AS pos, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') AS w FROM lines GROUP BY l),
whole AS (SELECT l, pos, array_to_string(w, ' ') AS k, w FROM firsts WHERE len(w) >= {line_dedup.NEAR_WORDS}),
less AS (SELECT l, pos, p, array_to_string(w[1:p-1] || w[p+1:], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM whole)),
near AS (
  SELECT a.l FROM less a JOIN (SELECT k, p, min(pos) AS early FROM less GROUP BY ALL) USING (k, p) WHERE early < pos
  UNION SELECT a.l FROM whole a JOIN (SELECT k, min(pos) AS early FROM whole GROUP BY k UNION ALL SELECT k, min(pos) FROM less GROUP BY k) USING (k) WHERE early < pos
  UNION SELECT a.l FROM less a JOIN (SELECT k, min(pos) AS early FROM whole GROUP BY k) USING (k) WHERE early < pos),
why AS (SELECT x.doc_id, x.i, (x.doc_id, x.i) > f.pos AS again, n.l IS NOT NULL AS near FROM lines x JOIN firsts f USING (l) LEFT JOIN near n USING (l)),
marked AS (SELECT e.*, coalesce(again, false) AS exact, coalesce(near, false) AND NOT coalesce(again, false) AS near, w.i IS NOT NULL AS has FROM every e LEFT JOIN why w USING (doc_id, i))
SELECT doc_id, CAST(count(*) FILTER (has) AS BIGINT) AS n_lines, CAST(count(*) FILTER (exact) AS BIGINT) AS n_exact, CAST(count(*) FILTER (near) AS BIGINT) AS n_near,
  CAST(length(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT exact AND NOT near), '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT exact AND NOT near), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * hits >= 90 * (p.n + q.n - hits)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT x, y FROM both_ways UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT rn, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS k FROM grams) WHERE k > 1),
places AS (SELECT rn, count(DISTINCT i) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY rn),
counts AS (
  SELECT d.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(places.n, 0) AS n_repeat_words FROM d LEFT JOIN places USING (rn)),
rules AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
    100 * n_symbols > {quality.MAX_SYMBOLS} * n_words OR 100 * (len(ls) - len(list_distinct(ls))) > {quality.MAX_DUP_LINES} * len(ls) AS soft_failed,
    100 * n_symbols > {2 * quality.MAX_SYMBOLS} * n_words OR 100 * (len(ls) - len(list_distinct(ls))) > {2 * quality.MAX_DUP_LINES} * len(ls) AS gross_failed FROM counts),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed OR soft_failed) AS DOUBLE) AS k FROM rules GROUP BY source),
sums AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(k) / sum(n) AS m, sum(n * n) AS nn, sum(k * k / n) AS kk FROM hosts),
prior AS (SELECT m, CASE WHEN hosts < 2 OR m <= 0 OR m >= 1 OR b <= 0 THEN docs ELSE least(docs, greatest(1.0, m * (1 - m) / b - 1)) END AS s FROM (SELECT *, (kk - docs * m * m - (hosts - 1) * m * (1 - m)) / (docs - nn / docs) AS b FROM sums)),
verdicts AS (SELECT source, (k + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT (rate > {quality.MAX_HOST_RATE} AND soft_failed) AND NOT (rate > {quality.WATCHED_RATE} AND gross_failed) AS kept, round(rate, 6) AS host_rate FROM rules r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_ngram_join, op4_url_filters, op5_token_counts, op6_secrets, op7_decontaminate, op8_sentencepiece, op9_licenses, op10_quality_rules)}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op3_ngram_join": OP3_SQL, "op10_quality_rules": OP10_SQL, "op4_url_filters": OP4_SQL, "op6_secrets": _op6_sql()}

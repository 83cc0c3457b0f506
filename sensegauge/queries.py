"""Queries of the library's operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensegauge.functions import stats, text
from sensegauge.functions.vectors import cosine
from sensegauge.operators import coverage, metrics, pairs, runs, summary
from sensegauge.plans import evaluate, reports, train
from sensegauge.sources.sinks import as_events
from sensegauge.sources.tables import stop_words

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short(**columns: Column) -> list[Column]:
    return [F.round(c, DIGITS).alias(k) for k, c in columns.items()]


# --- pairs of vectors -------------------------------------------------------------------------------------------------


def _vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with itself (rated 100), and with the next three by id (rated 100 if of one label, else 0)."""
    e = table(spark, sf_dir, "embeddings")
    own = e.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("gap")).withColumn("other", F.col("vec_id") + F.col("gap"))
    other = e.select(F.col("vec_id").alias("other"), F.col("label").alias("other_label"), F.col("embedding").alias("other_embedding"))
    return own.join(other, "other").select("vec_id", "gap", (F.col("label") == F.col("other_label")).alias("same"), cosine(F.col("embedding"), F.col("other_embedding")).alias("score"))


_COSINE = """
WITH v AS (SELECT a.vec_id, b.vec_id - a.vec_id AS gap, a.label = b.label AS same,
    100 * list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))
      / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + 3)
"""


@query(_COSINE + """
SELECT 'same_sentence' AS kind, count(*) AS n, round(sqrt(avg((score - 100) ** 2)), 6) AS rmse, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS st_dev, round(stddev_pop(score), 6) AS st_dev_pop,
  round(100 * avg(CAST(round_even(score, 0) > 95 AS INT)), 6) AS ratio_a, round(100 * avg(CAST(round_even(score, 0) > 99 AS INT)), 6) AS ratio_b, round(100 * avg(CAST(round_even(score, 0) = 100 AS INT)), 6) AS ratio_equals FROM v WHERE gap = 0
UNION ALL
SELECT 'irrelevant_sentence', count(*), round(sqrt(avg(score ** 2)), 6), round(avg(score), 6), round(stddev_samp(score), 6), round(stddev_pop(score), 6),
  round(100 * avg(CAST(round_even(score, 0) < 5 AS INT)), 6), round(100 * avg(CAST(round_even(score, 0) < 1 AS INT)), 6), round(100 * avg(CAST(round_even(score, 0) = 0 AS INT)), 6) FROM v WHERE gap > 0 AND NOT same
""")
def cosine_holdouts(spark, sf_dir):
    """Both sanity checks on the cosine metric."""
    v = _vector_pairs(spark, sf_dir)

    def of(kind, rows, label):
        p, y = F.col("score"), F.lit(float(label))
        a = summary.aggregates(kind, p, y)
        first, second = ("ratio_95", "ratio_99") if kind == summary.IDENTICAL else ("ratio_5", "ratio_1")
        return rows.agg(F.count("*").alias("n"), *short(rmse=a["rmse"], mean=a["mean"], st_dev=a["st_dev"], st_dev_pop=stats.stdev(p, population=True), ratio_a=a[first], ratio_b=a[second], ratio_equals=a["ratio_equals"])).select(F.lit(kind).alias("kind"), "*")

    return of(summary.IDENTICAL, v.where("gap = 0"), 100).unionByName(of(summary.UNRELATED, v.where("gap > 0 and not same"), 0))


def _pvalue(r: str, n: str) -> str:
    """Two-sided p-value of a correlation in SQL: the finite series of Student's t with n - 2 degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0) + j * ln(1 - {r} * {r}))))"
    odd = f"(asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * list_sum(list_transform(range(0, ({n} - 3) // 2), lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5) + j * ln(1 - {r} * {r}))))) * 2 / pi()"
    return f"(1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END)"


_LABELLED = ", p AS (SELECT score AS p, CASE WHEN same THEN 100.0 ELSE 0.0 END AS y FROM v WHERE gap > 0)"


@query(_COSINE + _LABELLED + """
SELECT count(*) AS n, round(corr(p, y), 6) AS pearson_corr, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS "R2", round(sqrt(avg((p - y) ** 2)), 6) AS rmse, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS st_dev FROM p
""")
def cosine_vs_label(spark, sf_dir):
    """Correlation with ratings; R2 is negative here."""
    v = _vector_pairs(spark, sf_dir).where("gap > 0").withColumn("y", F.when(F.col("same"), 100.0).otherwise(0.0))
    a = summary.aggregates(summary.TEST, F.col("score"), F.col("y"))
    return v.agg(a["n"].alias("n"), *short(**{k: a[k] for k in ("pearson_corr", "R2", "rmse", "mean", "st_dev")}))


@query(_COSINE + _LABELLED + f"""
SELECT round(r, 6) AS pearson_corr, round({_pvalue("r", "n")}, 6) AS pearson_pvalue, round(r2, 6) AS "R2", round(rmse, 6) AS rmse, round(mean, 6) AS mean, round(sd, 6) AS st_dev
FROM (SELECT count(*) AS n, corr(p, y) AS r, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((p - y) ** 2)) AS rmse, avg(p) AS mean, stddev_pop(p) AS sd FROM p)
""")
def correlation_pvalue(spark, sf_dir):
    """The bundle of a model's predictions, with the two-sided p-value and the deviation of the population."""
    v = _vector_pairs(spark, sf_dir).where("gap > 0").withColumn("label", F.when(F.col("same"), 100.0).otherwise(0.0))
    out = summary.predictions(v.select(F.col("score").alias("prediction"), "label"), summary.TEST)
    return out.select(*short(**{c: F.col(c) for c in ("pearson_corr", "pearson_pvalue", "R2", "rmse", "mean", "st_dev")}))


@query(_COSINE + """
SELECT vec_id, gap, round_even(score, 0) > 95 AS over_95, round_even(score, 0) > 99 AS over_99, round_even(score, 0) = 100 AS is_100, round_even(score, 0) < 1 AS under_1, round_even(score, 0) < 5 AS under_5, round_even(score, 0) = 0 AS is_0 FROM v
""")
def threshold_flags(spark, sf_dir):
    s = F.col("score")
    tests = {"over_95": stats.ABOVE["ratio_95"], "over_99": stats.ABOVE["ratio_99"], "is_100": stats.ABOVE["ratio_equals"], "under_1": stats.BELOW["ratio_1"], "under_5": stats.BELOW["ratio_5"], "is_0": stats.BELOW["ratio_equals"]}
    return _vector_pairs(spark, sf_dir).select("vec_id", "gap", *(f(s).alias(k) for k, f in tests.items()))


@query(_COSINE + """
SELECT 'none' AS kind, count(*) AS n, CAST(NULL AS DOUBLE) AS pearson_corr, CAST(NULL AS DOUBLE) AS "R2", round(sqrt(avg((score - 100) ** 2)), 6) AS rmse FROM v WHERE gap = 0
""")
def constant_label(spark, sf_dir):
    """Ratings without variance: correlation and R2 are null, not an error."""
    p, y = F.col("score"), F.lit(100.0)
    return _vector_pairs(spark, sf_dir).where("gap = 0").agg(F.count("*").alias("n"), *short(pearson_corr=stats.pearson(p, y), R2=stats.r2(p, y), rmse=stats.rmse(p, y))).select(F.lit("none").alias("kind"), "*")


# --- pairs of texts ---------------------------------------------------------------------------------------------------


def _turns_with_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, original (a turn), simplification (the next one), with label, split and conv_id; an equi-join, no window."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("simplification"))
    both = c.select("conv_id", "turn", F.col("text").alias("original")).join(after, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.lit(summary.TEST).alias("split"), "original", "simplification", F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(101)).cast("double").alias("label"), "conv_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns_with_conv(spark, sf_dir).drop("conv_id")


def _score(spark, sf_dir, *names: str) -> DataFrame:
    scored = metrics.score(turns(spark, sf_dir), names)
    return scored.select("pair_id", *(F.round(F.col(f"`{n}`"), DIGITS).alias(n.lower().replace("-", "_").replace(" ", "_").replace("(", "").replace(")", "")) for n in names))


_TURNS = r"""
WITH pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS pair_id, regexp_extract_all(lower(a.text), '[\p{L}\p{N}]+') AS o, regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+') AS s, a.text AS original, b.text AS simplification
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
sized AS (SELECT *, len(o) AS lo, len(s) AS ls FROM pairs),
orders AS (SELECT pair_id, o, s, unnest([1, 2, 3, 4]) AS n FROM pairs),
og AS (SELECT pair_id, n, array_to_string(o[i:i+n-1], ' ') AS g, count(*) AS k FROM (SELECT pair_id, n, o, unnest(range(1, len(o) - n + 2)) AS i FROM orders) GROUP BY ALL),
sg AS (SELECT pair_id, n, array_to_string(s[i:i+n-1], ' ') AS g, count(*) AS k FROM (SELECT pair_id, n, s, unnest(range(1, len(s) - n + 2)) AS i FROM orders) GROUP BY ALL),
met AS (SELECT pair_id, n, sum(least(og.k, sg.k)) AS hits, sum(least(og.k, sg.k) / og.k) AS kept FROM og JOIN sg USING (pair_id, n, g) GROUP BY ALL),
counts AS (
  SELECT z.pair_id, n, lo, ls, coalesce(hits, 0) AS hits, coalesce(kept, 0) AS kept, coalesce(a.d, 0) AS od, coalesce(b.d, 0) AS sd, coalesce(c.d, 0) AS cd
  FROM sized z CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) LEFT JOIN met USING (pair_id, n)
  LEFT JOIN (SELECT pair_id, n, count(*) AS d FROM og GROUP BY ALL) a USING (pair_id, n) LEFT JOIN (SELECT pair_id, n, count(*) AS d FROM sg GROUP BY ALL) b USING (pair_id, n)
  LEFT JOIN (SELECT pair_id, n, count(*) AS d FROM og JOIN sg USING (pair_id, n, g) WHERE og.k <= sg.k GROUP BY ALL) c USING (pair_id, n)),
shared AS (SELECT pair_id, n, count(*) AS d FROM og JOIN sg USING (pair_id, n, g) GROUP BY ALL),
bleu AS (
  SELECT pair_id, CASE WHEN any_value(lo) = 0 OR any_value(ls) = 0 THEN NULL WHEN max(CASE WHEN n = 1 THEN hits END) = 0 THEN 0.0 ELSE
    100 * exp(least(0.0, 1 - any_value(lo) / any_value(ls)) + avg(CASE WHEN hits > 0 THEN ln(hits / (ls - n + 1)) ELSE -ln(2.0 ** zeros * (ls - n + 1)) END)) END AS bleu
  FROM (SELECT *, sum(CAST(hits = 0 AS INT)) OVER (PARTITION BY pair_id ORDER BY n) AS zeros FROM counts WHERE n <= greatest(ls, 1)) GROUP BY pair_id),
sari AS (
  SELECT pair_id, CASE WHEN any_value(lo) = 0 OR any_value(ls) = 0 THEN NULL ELSE 100 * sum(keep + del + added) / 12 END AS sari FROM (
    SELECT c.pair_id, c.lo, c.ls, 2 * keep_r / (1 + keep_r) AS keep, CASE WHEN cd = od THEN 1.0 ELSE 0.0 END AS del, CASE WHEN coalesce(h.d, 0) = sd THEN 1.0 ELSE 0.0 END AS added
    FROM (SELECT *, CASE WHEN od = 0 THEN 1.0 ELSE kept / od END AS keep_r FROM counts) c LEFT JOIN shared h USING (pair_id, n)) GROUP BY pair_id)
"""


@query(_TURNS + """
SELECT pair_id, round(max(CASE WHEN n = 1 THEN f END), 6) AS rouge_1, round(max(CASE WHEN n = 2 THEN f END), 6) AS rouge_2 FROM (
  SELECT pair_id, n, CASE WHEN lo = 0 OR ls = 0 THEN NULL WHEN hits = 0 THEN 0.0 ELSE 100 * 2 * hits / ((lo - n + 1) + (ls - n + 1)) END AS f FROM counts) GROUP BY pair_id
""")
def rouge_adjacent_turns(spark, sf_dir):
    return _score(spark, sf_dir, "ROUGE-1", "ROUGE-2")


@query(_TURNS + "SELECT pair_id, round(bleu, 6) AS bleu, round(0.8 * bleu, 6) AS ibleu FROM bleu")
def bleu_adjacent_turns(spark, sf_dir):
    return _score(spark, sf_dir, "BLEU", "IBLEU")


@query(_TURNS + """
SELECT pair_id, round(sari, 6) AS sari, round((sari + bleu) / 2, 6) AS bleu_sari_am, round(CASE WHEN sari > 0 AND bleu > 0 THEN sqrt(sari * bleu) WHEN sari IS NOT NULL AND bleu IS NOT NULL THEN 0.0 END, 6) AS bleu_sari_gm FROM sari JOIN bleu USING (pair_id)
""")
def sari_adjacent_turns(spark, sf_dir):
    return _score(spark, sf_dir, "SARI", "BLEU-SARI (AM)", "BLEU-SARI (GM)")


_FKGL = """0.39 * len(w) / greatest(1, len(regexp_extract_all({t}, '{sentence}'))) + 11.8 * list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '{vowels}'))))) / len(w) - 15.59"""


def _fkgl_sql(t: str, w: str) -> str:
    return "(" + _FKGL.format(t=t, sentence=text.SENTENCE, vowels=text.VOWELS).replace("len(w)", f"len({w})").replace("list_transform(w,", f"list_transform({w},") + ")"


@query(_TURNS + f"""
SELECT z.pair_id, CASE WHEN ls > 0 THEN round({_fkgl_sql("simplification", "s")}, 6) END AS fkgl, round(0.8 * bleu / (1 + exp(-({_fkgl_sql("simplification", "s")} - {_fkgl_sql("original", "o")}))), 6) AS fkbleu FROM sized z JOIN bleu USING (pair_id)
""")
def readability_adjacent_turns(spark, sf_dir):
    return _score(spark, sf_dir, "FKGL", "FKBLEU")


@query(rf"""
SELECT doc_id, CASE WHEN len(w) > 0 THEN round({_fkgl_sql("text", "w")}, 6) END AS fkgl FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '{text.WORD}') AS w FROM documents WHERE lang = 'en')
""")
def fkgl_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.round(text.fkgl(F.col("text")), DIGITS).alias("fkgl"))


@query()
def alignment_adjacent_turns(spark, sf_dir):
    """Metrics that align words: dynamic programmes, tested against plain ones."""
    return _score(spark, sf_dir, "ROUGE-L", "TER", "METEOR (exact)")


_EQUAL = """
WITH firsts AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text),
p AS (SELECT doc_id, first, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents JOIN firsts USING (text) WHERE doc_id > first)
"""


@query(_EQUAL + """
SELECT doc_id AS pair_id, first, CASE WHEN n = 0 THEN NULL ELSE 100.0 END AS rouge_1, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 0.0 ELSE 100.0 END AS rouge_2, CASE WHEN n = 0 THEN NULL ELSE 100.0 END AS bleu FROM p
""")
def identical_text_pairs(spark, sf_dir):
    """Each later copy of a text with the first one: linear in the copies."""
    d = table(spark, sf_dir, "documents")
    firsts = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("f"))
    p = d.withColumn("h", F.sha2("text", 256)).join(firsts, "h").where(F.col("doc_id") > F.col("f.doc_id"))
    p = p.select(F.col("doc_id").alias("pair_id"), F.col("f.doc_id").alias("first"), F.col("f.text").alias("original"), F.col("text").alias("simplification"))
    return metrics.score(p, ["ROUGE-1", "ROUGE-2", "BLEU"]).select("pair_id", "first", *(F.round(F.col(f"`{n}`"), DIGITS).alias(a) for n, a in (("ROUGE-1", "rouge_1"), ("ROUGE-2", "rouge_2"), ("BLEU", "bleu"))))


@query(_TURNS + """
SELECT label, md5(original) AS original_md5, md5(simplification) AS simplification_md5 FROM (
  SELECT original, simplification, CAST(((pair_id // 1000) * 7 + (pair_id % 1000) * 13) % 101 AS DOUBLE) AS label FROM pairs
  UNION SELECT simplification, original, CAST(((pair_id // 1000) * 7 + (pair_id % 1000) * 13) % 101 AS DOUBLE) FROM pairs)
""")
def augment_commutative(spark, sf_dir):
    return pairs.augment(turns(spark, sf_dir)).select("label", F.md5("original").alias("original_md5"), F.md5("simplification").alias("simplification_md5"))


@query(rf"""
WITH p AS (SELECT {_fkgl_sql("text", "w")} AS p, quality * 100.0 AS y FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '{text.WORD}') AS w FROM documents) JOIN labels USING (doc_id) WHERE len(w) > 0)
SELECT count(*) AS n, round(corr(p, y), 6) AS pearson_corr, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS "R2", round(sqrt(avg((p - y) ** 2)), 6) AS rmse FROM p
""")
def quality_correlation(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    a = summary.aggregates(summary.TEST, F.col("p"), F.col("y"))
    return both.select(text.fkgl(F.col("text")).alias("p"), (F.col("quality") * 100.0).alias("y")).agg(a["n"].alias("n"), *short(pearson_corr=a["pearson_corr"], R2=a["R2"], rmse=a["rmse"]))


# --- whole evaluations ------------------------------------------------------------------------------------------------


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns, each turn with itself, and each with a turn of another conversation."""
    own = _turns_with_conv(spark, sf_dir)
    return own.drop("conv_id").unionByName(pairs.identical(own, "pair_id", "original")).unionByName(pairs.unrelated(own, "pair_id", "original", "conv_id"))


@query()
def benchmark_metrics(spark, sf_dir):
    """All metrics that need no model, summarised on the three kinds of split in one pass."""
    return evaluate.benchmark_metrics(all_pairs(spark, sf_dir))


NGRAM = ("ROUGE-1", "ROUGE-2", "BLEU", "IBLEU", "SARI", "BLEU-SARI (AM)", "BLEU-SARI (GM)", "FKGL", "FKBLEU")
_LONG = _TURNS + f"""
, rouge AS (SELECT pair_id, n, CASE WHEN lo = 0 OR ls = 0 THEN NULL WHEN hits = 0 THEN 0.0 ELSE 100 * 2 * hits / ((lo - n + 1) + (ls - n + 1)) END AS f FROM counts WHERE n <= 2),
grade AS (SELECT pair_id, CASE WHEN ls > 0 THEN {_fkgl_sql("simplification", "s")} END AS s, CASE WHEN lo > 0 THEN {_fkgl_sql("original", "o")} END AS o FROM sized),
long AS (
  SELECT pair_id, 'ROUGE-' || n AS metric, f AS score FROM rouge UNION ALL SELECT pair_id, 'BLEU', bleu FROM bleu UNION ALL SELECT pair_id, 'IBLEU', 0.8 * bleu FROM bleu UNION ALL SELECT pair_id, 'SARI', sari FROM sari
  UNION ALL SELECT pair_id, 'BLEU-SARI (AM)', (sari + bleu) / 2 FROM sari JOIN bleu USING (pair_id)
  UNION ALL SELECT pair_id, 'BLEU-SARI (GM)', CASE WHEN sari > 0 AND bleu > 0 THEN sqrt(sari * bleu) WHEN sari IS NOT NULL AND bleu IS NOT NULL THEN 0.0 END FROM sari JOIN bleu USING (pair_id)
  UNION ALL SELECT pair_id, 'FKGL', s FROM grade UNION ALL SELECT pair_id, 'FKBLEU', 0.8 * bleu / (1 + exp(o - s)) FROM grade JOIN bleu USING (pair_id)),
y AS (SELECT metric, score AS p, CAST(((pair_id // 1000) * 7 + (pair_id % 1000) * 13) % 101 AS DOUBLE) AS y FROM long WHERE score IS NOT NULL),
stats AS (SELECT metric, count(*) AS n, corr(p, y) AS r, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((p - y) ** 2)) AS rmse, avg(p) AS mean, stddev_samp(p) AS sd FROM y GROUP BY metric)
"""


@query(_LONG + f"""
SELECT 'test' AS split, metric, round(r, 6) AS pearson_corr, round({_pvalue("r", "n")}, 6) AS pearson_pvalue, round(r2, 6) AS "R2", round(rmse, 6) AS rmse, round(mean, 6) AS mean, round(sd, 6) AS st_dev FROM stats
""")
def test_summary(spark, sf_dir):
    """Unpivoted scores of nine metrics, summarised by metric."""
    out = summary.metrics(metrics.long(metrics.score(turns(spark, sf_dir), NGRAM), NGRAM), summary.TEST)
    return out.select("split", "metric", *short(**{k: F.col(k) for k in ("pearson_corr", "pearson_pvalue", "R2", "rmse", "mean", "st_dev")}))


@query(rf"""
WITH t AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, len(regexp_extract_all(lower(a.text), '{text.WORD}')) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT pair_id, CASE WHEN n > 0 THEN 100.0 END AS rouge_l, CASE WHEN n > 0 THEN 100.0 END AS ter, CASE WHEN n > 0 THEN round(100 * (1 - 0.5 * (1.0 / n) ** 3), 6) END AS meteor_exact FROM t
""")
def alignment_identical_turns(spark, sf_dir):
    """Metrics that align words, on pairs of equal texts: all words match in one chunk."""
    own = pairs.identical(turns(spark, sf_dir), "pair_id", "original")
    scored = metrics.score(own, ["ROUGE-L", "TER", "METEOR (exact)"])
    return scored.select("pair_id", *short(rouge_l=F.col("`ROUGE-L`"), ter=F.col("`TER`"), meteor_exact=F.col("`METEOR (exact)`")))


@query(_LONG + f"""
SELECT 'run-1' AS run_id, CAST(0 AS BIGINT) AS step, 'test/' || metric || '_' || stat AS key, round(value, 6) AS value FROM (
  SELECT metric, unnest(['pearson_corr', 'pearson_pvalue', 'R2', 'rmse', 'mean', 'st_dev']) AS stat, unnest([r, {_pvalue("r", "n")}, r2, rmse, mean, sd]) AS value FROM stats WHERE metric IN ('ROUGE-1', 'BLEU'))
""")
def metric_events(spark, sf_dir):
    """The same as events of a run's log, with their keys."""
    events = as_events(evaluate.benchmark_metrics(turns(spark, sf_dir), ["ROUGE-1", "BLEU"]), "run-1", 0)
    return events.withColumn("value", F.round("value", DIGITS))


@query()
def train_regression(spark, sf_dir):
    """A regression on metric scores, fitted and evaluated on the three kinds of split."""
    p = all_pairs(spark, sf_dir)
    return train.evaluate(train.predict(train.fit(p.where("split = 'test'")), p))


# --- runs and reports -------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def last_value_per_key(spark, sf_dir):
    return runs.last_values(_log(spark, sf_dir), "user_id", "event_type", ("ts", "event_id"))


_LAST = """
WITH last AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type),
cohort AS (SELECT *, CASE user_id % 5 WHEN 0 THEN 'plain_250_fixed' WHEN 1 THEN 'augmented_250_fixed' WHEN 2 THEN 'plain_500_fixed' WHEN 3 THEN 'augmented_500_fixed' END AS cohort FROM last),
means AS (SELECT cohort, event_type, avg(value) AS mean, stddev_samp(value) AS stdev, count(*) AS n_runs FROM cohort WHERE cohort IS NOT NULL GROUP BY ALL)
"""


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for runs; their ids give the setting, and one in five fits none."""
    last = last_value_per_key(spark, sf_dir)
    kind = F.pmod("user_id", F.lit(5))
    settings = last.withColumns({"augmented": kind.isin(1, 3), "epochs": F.when(kind < 2, 250).when(kind < 4, 500).otherwise(100), "variant": F.lit("holdout fixed")})
    return runs.route(settings)


@query(_LAST + "SELECT cohort, event_type, round(mean, 6) AS mean, round(stdev, 6) AS stdev, n_runs FROM means")
def cohort_summary(spark, sf_dir):
    return runs.over_runs(_cohorts(spark, sf_dir), ["cohort", "event_type"]).select("cohort", "event_type", *short(mean=F.col("mean"), stdev=F.col("stdev")), "n_runs")


@query(_LAST + """
SELECT cohort, event_type, round(m.mean, 6) AS mean, round(m.mean, 9) = round(max(m.mean) OVER (PARTITION BY event_type), 9) AS is_high, round(m.mean, 9) = round(min(m.mean) OVER (PARTITION BY event_type), 9) AS is_low FROM means m
""")
def best_in_column(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("event_type")  # a few cohorts each
    out = runs.over_runs(_cohorts(spark, sf_dir), ["cohort", "event_type"])
    return out.select("cohort", "event_type", *short(mean=F.col("mean")), (F.col("mean") == F.max("mean").over(by)).alias("is_high"), (F.col("mean") == F.min("mean").over(by)).alias("is_low"))


def _report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as metrics; the first by name is the model."""
    kind, user = F.col("event_type"), F.col("user_id")
    metric = F.when(kind == "click", reports.MODEL).otherwise(kind)
    stat = F.explode(F.array(F.struct(F.lit("pearson_corr").alias("stat"), F.col("value").alias("value")), F.struct(F.lit("rmse").alias("stat"), F.abs(F.col("value") - 50).alias("value")), F.struct(F.lit("pearson_pvalue").alias("stat"), F.when(kind.isin("click", "view"), 0.0).otherwise(0.5).alias("value"))))
    return _cohorts(spark, sf_dir).select(user.alias("run_id"), "cohort", F.lit("test").alias("split"), metric.alias("metric"), stat.alias("v")).select("run_id", "cohort", "split", "metric", "v.*")


@query(_LAST + """
, cells AS (
  SELECT CASE WHEN event_type = 'click' AND cohort = 'plain_250_fixed' THEN 'Trained model' WHEN event_type = 'click' AND cohort = 'augmented_250_fixed' THEN 'Trained model (augmented)'
    WHEN event_type <> 'click' AND cohort = 'plain_500_fixed' THEN event_type END AS row_name, value FROM cohort),
rows AS (SELECT row_name, 'pearson_corr' AS col_name, avg(value) AS mean, stddev_samp(value) AS stdev, count(*) AS n_runs FROM cells WHERE row_name IS NOT NULL GROUP BY ALL
  UNION ALL SELECT row_name, 'rmse', avg(abs(value - 50)), stddev_samp(abs(value - 50)), count(*) FROM cells WHERE row_name IS NOT NULL GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY CASE row_name WHEN 'Trained model' THEN 1 WHEN 'Trained model (augmented)' THEN 2 ELSE 0 END, row_name) + CASE WHEN row_name LIKE 'Trained%' THEN 1 ELSE 0 END AS row_idx,
  row_name, col_name, round(r.mean, 6) AS mean, round(r.stdev, 6) AS stdev, n_runs, CASE WHEN col_name = 'rmse' THEN round(r.mean, 9) = round(min(r.mean) OVER (PARTITION BY col_name), 9) ELSE round(r.mean, 9) = round(max(r.mean) OVER (PARTITION BY col_name), 9) END AS is_best FROM rows r
""")
def report_layout(spark, sf_dir):
    """The correlation report on stand-in runs: rows in order, mean and deviation, best of each column."""
    out = reports.cells(_report_values(spark, sf_dir), reports.CORRELATION)
    return out.select(F.col("row_idx").cast("long").alias("row_idx"), "row_name", "col_name", *short(mean=F.col("mean"), stdev=F.col("stdev")), "n_runs", "is_best")


def _number(x: str, digits: int) -> str:
    return rf"regexp_replace(regexp_replace(CAST(CAST(round_even({x}, {digits}) AS DECIMAL(38, 6)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '')"


def _report_sql(plain: str, augmented: str, columns: dict[str, tuple[str, bool]], sure: str = "false") -> str:
    """Rows of a report; columns: by statistic what stands for its value, and whether high is best."""
    rows = " UNION ALL ".join(f"SELECT row_name, '{c}' AS col_name, avg({x}) AS mean, stddev_samp({x}) AS stdev, count(*) AS n_runs FROM cells WHERE row_name IS NOT NULL GROUP BY row_name" for c, (x, _) in columns.items())
    high = ", ".join(f"'{c}'" for c, (_, up) in columns.items() if up)
    return _LAST + f"""
, cells AS (
  SELECT CASE WHEN event_type = 'click' AND cohort = '{plain}' THEN 'Trained model' WHEN event_type = 'click' AND cohort = '{augmented}' THEN 'Trained model (augmented)'
    WHEN event_type <> 'click' AND cohort = 'plain_500_fixed' THEN event_type END AS row_name, value FROM cohort),
rows AS ({rows})
SELECT CAST(dense_rank() OVER (ORDER BY CASE row_name WHEN 'Trained model' THEN 1 WHEN 'Trained model (augmented)' THEN 2 ELSE 0 END, row_name) + CASE WHEN row_name LIKE 'Trained%' THEN 1 ELSE 0 END AS BIGINT) AS row_idx, row_name, col_name,
  {_number("r.mean", 3)} || coalesce('±' || {_number("r.stdev", 2)}, '') AS text,
  CASE WHEN col_name IN ({high}) THEN r.mean = max(r.mean) OVER (PARTITION BY col_name) ELSE r.mean = min(r.mean) OVER (PARTITION BY col_name) END AS is_best, {sure} AS is_significant FROM rows r
"""


def _texts_of(values: DataFrame, report) -> DataFrame:
    out = reports.with_text(reports.cells(values, report))
    return out.select(F.col("row_idx").cast("long").alias("row_idx"), "row_name", "col_name", "text", "is_best", "is_significant")


@query(_report_sql("plain_250_fixed", "augmented_250_fixed", {"pearson_corr": ("value", True), "rmse": ("abs(value - 50)", False)}, "(col_name = 'pearson_corr' AND (row_name = 'view' OR row_name LIKE 'Trained%'))"))
def report_text(spark, sf_dir):
    """Cells as text, with italics for significance."""
    return _texts_of(_report_values(spark, sf_dir), reports.CORRELATION)


def _holdout_values(spark: SparkSession, sf_dir: str, split: str, **columns: Column) -> DataFrame:
    kind = F.col("event_type")
    stat = F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), c.alias("value")) for k, c in columns.items())))
    return _cohorts(spark, sf_dir).select(F.col("user_id").alias("run_id"), "cohort", F.lit(split).alias("split"), F.when(kind == "click", reports.MODEL).otherwise(kind).alias("metric"), stat.alias("v")).select("run_id", "cohort", "split", "metric", "v.*")


@query(_report_sql("plain_500_fixed", "augmented_500_fixed", {"ratio_95": ("value / 1.1", True), "ratio_99": ("value / 2.3", True)}))
def identical_report(spark, sf_dir):
    """The report on identical pairs, on stand-in runs."""
    v = F.col("value")
    return _texts_of(_holdout_values(spark, sf_dir, summary.IDENTICAL, ratio_95=v / 1.1, ratio_99=v / 2.3, ratio_equals=v / 3.7), reports.SAME)


@query(_report_sql("plain_500_fixed", "augmented_500_fixed", {"ratio_5": ("value / 1.1", True), "ratio_1": ("value / 2.3", True), "ratio_equals": ("value / 3.7", True)}))
def unrelated_report(spark, sf_dir):
    """The report on unrelated pairs with its third column, on stand-in runs."""
    v = F.col("value")
    return _texts_of(_holdout_values(spark, sf_dir, summary.UNRELATED, ratio_5=v / 1.1, ratio_1=v / 2.3, ratio_equals=v / 3.7), reports.OTHER.with_equals())


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(value, event_id) AS last_click FROM events WHERE event_type = 'click' GROUP BY user_id")
def run_lookup(spark, sf_dir):
    """Run summaries as maps, and one key looked up, which all runs here have."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("key"), F.col("event_id").alias("step"), "value")
    found = runs.summaries(log).where(F.map_contains_key("summary", F.lit("click")))
    return found.select("run_id", runs.lookup(F.col("summary"), "click").alias("last_click"))


@query("SELECT o_orderkey, o_orderstatus <> 'O' AS parsed FROM orders")
def parse_booleans(spark, sf_dir):
    """Spellings of booleans stand for the status of an order."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_bool(F.when(status == "O", " No").when(status == "F", "TRUE").otherwise("y ")).alias("parsed"))


@query("""
SELECT o_custkey AS run_id, o_orderkey AS checkpoint, o_totalprice AS eval_loss FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def best_checkpoint(spark, sf_dir):
    """Orders stand for evaluations of a run, their price for the loss."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("eval_loss"), F.col("o_orderkey").alias("checkpoint"))
    return runs.best_checkpoint(o)


@query("""
SELECT o_orderkey AS run_id, CASE WHEN aug AND epochs = 250 THEN 'augmented_250_fixed' WHEN NOT aug AND epochs = 250 THEN 'plain_250_fixed' WHEN aug THEN 'augmented_500_fixed' ELSE 'plain_500_fixed' END AS cohort
FROM (SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS aug, CASE o_orderkey % 3 WHEN 0 THEN 250 WHEN 1 THEN 500 ELSE 750 END AS epochs FROM orders WHERE o_orderstatus = 'F') WHERE epochs <> 750
""")
def route_runs(spark, sf_dir):
    """Orders stand for runs: finished ones are routed to cohorts by their settings, and those that fit none dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "finished").otherwise("running").alias("state"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("augmented"), F.when(F.col("o_orderkey") % 3 == 0, 250).when(F.col("o_orderkey") % 3 == 1, 500).otherwise(750).alias("epochs"), F.lit("holdout fixed").alias("variant"))
    return runs.route(runs.finished(o)).select("run_id", "cohort")


# --- coverage ---------------------------------------------------------------------------------------------------------


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of a word stands for its id."""
    return table(spark, sf_dir, "documents").select("doc_id", coverage.mask(F.col("text"), lambda w: F.array(F.length(w)), stop_words()).alias("m"))


_MASK = rf"""
WITH sents AS (SELECT doc_id, unnest(regexp_extract_all(text, '{text.SENTENCE}')) AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(lower(t), '{text.WORD}') AS w FROM sents),
r AS (SELECT doc_id, len(w) AS n, len(list_filter(range(1, len(w) + 1), lambda i: i % 2 = 0 AND w[i] NOT IN ({", ".join(f"'{w}'" for w in stop_words())}))) AS k FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_masked, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_words, round(avg(k / n), 6) AS effective_ratio FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id
"""


@query(_MASK)
def mask_words(spark, sf_dir):
    m = F.col("m")
    return _masked(spark, sf_dir).select("doc_id", F.size(coverage.flat(m, "masked_words")).cast("long").alias("n_masked"), F.size(coverage.flat(m, "unmasked")).cast("long").alias("n_words"), F.round(coverage.effective_ratio(m), DIGITS).alias("effective_ratio"))


@query("""
SELECT vec_id, round(100 * list_sum(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE)) * (i % 2))) / (32 + 0.1), 6) AS soft_score FROM embeddings
""")
def soft_coverage(spark, sf_dir):
    """The score's arithmetic: vector components stand for relative probabilities, every second one is flagged."""
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    flags = F.transform(e, lambda x, i: ((i + 1) % 2).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(coverage.soft_score(e, flags), DIGITS).alias("soft_score"))


@query(rf"""
WITH p AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS original, b.text AS simplification FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (
  SELECT pair_id, list_transform(regexp_extract_all(lower(simplification), '{text.WORD}'), lambda w: length(w))[1:{coverage.LONGEST}] AS g,
    flatten(list_transform(regexp_extract_all(original, '{text.SENTENCE}'), lambda t: list_transform(regexp_extract_all(lower(t), '{text.WORD}'),
      lambda w, i: struct_pack(n := length(w), hid := CAST(i % 2 = 0 AND w NOT IN ({", ".join(f"'{w}'" for w in stop_words())}) AS INT)))))[1:{coverage.LONGEST}] AS o FROM p)
SELECT pair_id, array_to_string(g || [2] || list_transform(o, lambda x: CASE WHEN x.hid = 1 THEN {coverage.MASK_ID} ELSE x.n END), ' ') AS ids,
  array_to_string(list_transform(range(len(g) + 1), lambda x: -1) || list_transform(o, lambda x: x.n), ' ') AS labels, array_to_string(list_transform(range(len(g) + 1), lambda x: 0) || list_transform(o, lambda x: x.hid), ' ') AS flags FROM m
""")
def coverage_input(spark, sf_dir):
    """Input of the language model: ids, labels, flags."""
    p = turns(spark, sf_dir)
    ids = lambda w: F.array(F.length(w))
    made = coverage.model_input(F.transform(text.words(F.col("simplification")), lambda w: F.length(w)), coverage.mask(F.col("original"), ids, stop_words()), 2)
    return p.select("pair_id", made.alias("x")).select("pair_id", *(F.array_join(F.transform(F.col("x")[c], lambda v: v.cast("string")), " ").alias(c) for c in ("ids", "labels", "flags")))

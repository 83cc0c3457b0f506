"""Quality rules with host verdicts.

``measure`` counts, for every whole text, what the rules look at. ``host_verdicts`` adds up rule failures by host and
shrinks each host's rate towards an empirical beta prior, whose parameters are the moments of all hosts' rates.
``judge`` joins the verdicts to the documents.

A verdict decides which soft rules count for a host's documents. On a trusted host (shrunk rate up to WATCHED_RATE) a
document that breaks a soft rule stays, as it is likely to be a table or a list; on a watched one it goes if it breaks
one by twice its limit; on a bad one (above MAX_HOST_RATE) if it breaks one at all. Documents that break no rule stay
whatever their host is.

Defined results: a null or empty text has no words and so fails ``n_words < 50``; very long texts are counted whole; a
null host is a host of its own; hosts of equal rates get equal verdicts; repeated rows are judged (and counted) each;
other columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensegauge.llm.kernels import LINES, TEXT, Words, map_slices, mix, text_bytes, windows
from sensegauge.llm.shared import cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Percentages; more than these fail. The last two are the soft rules.
MAX_REPEATED, MAX_SYMBOLS, MAX_DUP_LINES = 50, 25, 30
#: A host is watched, or bad, when its shrunk rate of documents that fail a rule is above.
WATCHED_RATE, MAX_HOST_RATE = 0.1, 0.5
#: Rows of host verdicts that are broadcast at most; beyond, the join is a shuffle.
BROADCAST_HOSTS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counter():
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    first = TEXT.inside & ((np.arange(256) & 0xC0) != 0x80)

    def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])

    def repeated(keys: np.ndarray) -> np.ndarray:
        """Which keys occur twice or more."""
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        out = np.zeros(len(keys), bool)
        out[order] = np.append(False, same) | np.append(same, False) if len(keys) else False
        return out

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("text"))
        words, lines = Words(data, offsets, TEXT), Words(data, offsets, LINES)
        n = len(offsets) - 1
        full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
        line_rows = lines.rows()[full]
        keys = mix(lines.codes[full] + mix(line_rows.astype(np.uint64)))
        order = np.lexsort((keys, line_rows))
        again = np.append(False, (keys[order][1:] == keys[order][:-1]) & (line_rows[order][1:] == line_rows[order][:-1])) if len(keys) else np.zeros(0, bool)
        dup_lines = np.bincount(line_rows[order][again], minlength=n)
        three, whole = windows(words, 3)
        rows, at = words.rows(), np.flatnonzero(whole)
        inside = np.zeros(len(three) + 2, bool)
        again = at[repeated(mix(three[at] + mix(rows[at].astype(np.uint64))))]
        for j in range(3):
            inside[again + j] = True
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("host"), *(pa.array(np.asarray(x, np.int64)) for x in (
                words.counts(), per_row(first[data], offsets), per_row(symbol[data], offsets), dup_lines, np.bincount(rows[inside[: len(three)]], minlength=n), np.bincount(line_rows, minlength=n)))],
            ["doc_id", "host", *COUNTS],
        )

    return of


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each document."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_slices(docs.select("doc_id", F.col(host).cast("string").alias("host"), "text"), counter, schema)


def failures(measured: DataFrame) -> DataFrame:
    def soft(times: int):
        return (100 * F.col("n_symbols") > times * MAX_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > times * MAX_DUP_LINES * F.col("n_lines"))

    return measured.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        "soft_failed": soft(1), "gross_failed": soft(2),
    })


def host_verdicts(failed: DataFrame) -> DataFrame:
    """host, n, rate (shrunk share of failures), verdict (0 trusted, 1 watched, 2 bad).

    Rates of hosts are taken as beta(a, b) and counts as binomial; a and b follow from the mean and variance over hosts
    (weighted by documents). With one host, or hosts that differ no more than chance, the prior is as strong as all
    documents together and every host gets the overall rate.
    """
    hosts = failed.groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    mean, strength = beta_prior(*hosts.agg(F.count("*"), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n)).first())
    rate = (k + mean * strength) / (n + strength)
    return hosts.select("host", "n", rate.alias("rate"), ((rate > WATCHED_RATE).cast("int") + (rate > MAX_HOST_RATE).cast("int")).alias("verdict"))


def beta_prior(hosts: int, docs: float | None, fails: float | None, squares: float | None, k2_n: float | None) -> tuple[float, float]:
    """Mean a / (a + b) and strength a + b, from sums over hosts: hosts, n, k, n * n, k * k / n."""
    if not docs:
        return 0.0, 1.0
    m = fails / docs
    if hosts < 2 or not 0 < m < 1:
        return m, docs
    between = (k2_n - docs * m * m - (hosts - 1) * m * (1 - m)) / (docs - squares / docs)
    return m, min(docs, max(1.0, m * (1 - m) / between - 1)) if between > 0 else docs


def judge(docs: DataFrame, host: str = "source", salts: int = 32) -> DataFrame:
    """doc_id, host, counts, base_failed, soft_failed, gross_failed, host_rate, host_verdict, kept.

    The counts are written once (checkpoint) and read twice: for the verdicts and for the join. Verdicts of few hosts
    are broadcast; a longer table is joined by host and salt, so that a host with a third of all rows is spread.
    """
    failed = cut(failures(measure(docs, host)))
    verdicts = cut(host_verdicts(failed).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict")))
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = failed.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("h")), "left")
    else:
        spread = verdicts.withColumn("salt_h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = failed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(salts)).cast("int"))
        joined = salted.join(spread, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("salt_h")), "left").drop("salt", "salt_h")
    return joined.drop("h").withColumn("kept", ~F.col("base_failed") & ~F.when(F.col("host_verdict") == 2, F.col("soft_failed")).when(F.col("host_verdict") == 1, F.col("gross_failed")).otherwise(False))

"""op4, op6, op7 against brute force and SQL, and the pipeline against its stages."""

import datetime as dt
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sensegauge.llm import decontaminate, queries, secrets, url_filters

SF = "/root/testdata/sf0.001"


# --- op4 --------------------------------------------------------------------------------------------------------------


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute_verdict(url, fetched, entries):
    m = re.match(url_filters.HOST, url or "")
    host = (m[1] if m else "").lower()
    if not host or fetched is None:
        return "none", None
    labels = host.split(".")
    seg = re.match(url_filters.SEGMENT, url)
    keys = [f"{host}/{seg[1].lower() if seg else ''}", *(".".join(labels[i:]) for i in range(max(1, len(labels) - 1)))]
    for key in keys:
        past = sorted((d, a) for k, a, d in entries if k and a and d and k.lower() == key and d <= fetched)
        if past and past[-1][1] != "lift":
            return past[-1][1], key
    return "none", None


@pytest.mark.parametrize("few", [10**6, 0])
def test_url_verdicts_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(url_filters, "FEW_INTERVALS", few)
    random.seed(few)
    hosts = ["a.com", "x.a.com", "Y.x.a.com", "b.org", "localhost", "x.b.org:8080"]
    entries = [(random.choice(["a.com", "x.a.com", "b.org", "A.com/p", "x.b.org/q", "localhost", "com"]), random.choice(["block", "allow", "lift"]), day(random.randrange(60))) for _ in range(60)] + [(None, "block", day(1)), ("b.org", None, day(2)), ("b.org", "block", None)]
    pages = [(i, f"{random.choice(['http', 'HTTPS'])}://{random.choice(['', 'user@'])}{random.choice(hosts)}{random.choice(['', '/', '/p', '/Q/r', '/q?x=1', '#p'])}", day(random.randrange(70))) for i in range(400)]
    pages += [(900, None, day(3)), (901, "", day(3)), (902, "no url", day(3)), (903, "http://a.com/p", None), (None, "http://a.com/p", day(50)), (5, *pages[5][1:]), (5, *pages[5][1:])]
    captures = spark.createDataFrame(pages, "page_id long, url string, fetched date").withColumn("key", F.lit("own"))
    got = url_filters.judge(captures, spark.createDataFrame(entries, "key string, action string, since date")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["verdict"], r["rule"]) == brute_verdict(r["url"], r["fetched"], entries), r
    none = spark.createDataFrame([], "key string, action string, since date")
    assert {r["verdict"] for r in url_filters.judge(captures, none).collect()} == {"none"}
    assert url_filters.judge(captures.where("false"), none).count() == 0


# --- op6 --------------------------------------------------------------------------------------------------------------


def brute_spans(text, rules):
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return sorted(out)


def secret_texts(seed):
    random.seed(seed)
    bits = ["token", "Password", "passwd", "SECRET", "api_key", "apikey", "API-KEY", " = ", ":", '"', "'", "=", "abcdefgh", "Zz9+/_.=-", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "ghp_" + "a" * 36, "xoxb-1234567890ab", "AIza" + "B" * 35, "sk_live_" + "c" * 16, "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.abcdefgh.abcdefgh", "é漢🙂", "K", " ", "\n", "glpat-" + "x" * 20, "npm_" + "q" * 36]
    return [(i, "".join(random.choice(bits) for _ in range(random.choice([0, 1, 3, 12, 60])))) for i in range(500)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_secrets_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(secrets, "few", lambda df: False)
    rows = secret_texts(broadcast) + [(600, None), (601, ""), (None, "token=abcdefgh1"), (3, "token=abcdefgh1"), (3, "token=abcdefgh1"), (602, "f" * 100_000 + " token: " + "a" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("own"), "rules": F.lit(1)})
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secrets.scan(df).collect()), key=str)
    assert got == sorted(((d, brute_spans(t, secrets.RULES)) for d, t in rows), key=str)
    assert secrets.scan(df.where("false")).count() == 0


def test_trigram_queries_hold_for_every_match(spark):
    texts = [t for _, t in secret_texts(7)]
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for t in texts:
            if re.search(rule.pattern, t, re.A):
                assert not query or any(all(g in t.lower() for g in clause) for clause in query)
    assert secrets.trigram_query("[0-9a-f]{32,}") == [] and secrets.trigram_query("ab(cd|e)f") == [frozenset({"abc", "bcd", "cdf"}), frozenset({"abe", "bef"})]
    assert secrets.trigram_query("a?bc.*") == [] and secrets.trigram_query("x*(hello|he)") == []


# --- op7 --------------------------------------------------------------------------------------------------------------


def brute_tile(doc, item, k):
    """Words of the item under tiles: the longest unmarked match first, the leftmost in the document of equal ones."""
    a, b, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return total
        a[i : i + n], b[j : j + n], total = [True] * n, [True] * n, total + n


def test_tiles_against_brute_force(spark):
    random.seed(4)
    items = [[random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 2) for _ in range(random.choice([3, 8, 20, 40]))] for _ in range(12)] + [["la"] * 12]
    docs = []
    for i in range(150):
        own = [f"w{random.randrange(300)}" for _ in range(random.choice([0, 10, 60]))]
        for _ in range(random.choice([0, 1, 2])):
            item = random.choice(items)
            parts = [item] if random.random() < 0.4 else [item[len(item) // 2 :], item[: len(item) // 2]]
            if random.random() < 0.3:
                parts = [[*p[: len(p) // 2], "changed", *p[len(p) // 2 + 1 :]] for p in parts]
            for p in parts:
                at = random.randrange(len(own) + 1)
                own[at:at] = p
        docs.append((i, own))
    df = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in docs] + [(900, None), (901, "")], "doc_id long, text string").withColumn("leaks", F.lit(0))
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)] + [(None, "null id of an item that nobody has"), (99, None), (98, "")], "item_id long, text string")
    for chars in (10**6, 100):  # one block, and many
        got = {r["doc_id"]: sorted((x["item_id"], x["covered"]) for x in r["leaks"]) for r in decontaminate.leaks(df, bench, coverage=0.5, block_chars=chars).collect()}
        for i, w in docs:
            exp = [(j, n) for j, item in enumerate(items) for n in [brute_tile(w, item, min(5, len(item)))] if n >= 0.5 * len(item)]
            assert got[i] == sorted(exp), i
        assert got[900] == got[901] == []
    found = decontaminate.remove(df, bench)
    assert found.columns == df.columns and found.count() == sum(not v for v in got.values())
    assert decontaminate.leaks(df, bench.where("false")).where("contaminated").count() == 0 and decontaminate.leaks(df.where("false"), bench).count() == 0


def test_tiles_of_one_word_that_is_repeated(spark):
    import numpy as np

    la = np.full(40_000, 7, np.uint64)
    assert decontaminate.tile(la, la[:800], 5) == 800 and decontaminate.tile(la[:300], la[:800], 5) == 300
    random.seed(12)
    for _ in range(200):
        doc, item = ([random.choice("ab") for _ in range(random.choice([0, 4, 12, 40]))] for _ in range(2))
        codes = [np.array([ord(x) for x in w], np.uint64) for w in (doc, item)]
        assert decontaminate.tile(*codes, 3) == brute_tile(doc, item, 3)
    df = spark.createDataFrame([(1, "la " * 40_000), (1, "la " * 40_000), (2, "no")], "doc_id long, text string").withColumns({"contaminated": F.lit("own"), "n_items": F.lit(1)})
    bench = spark.createDataFrame([(1, "la " * 800), (1, "la " * 800), (2, "x " * 800)], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_items"], [x["covered"] for x in r["leaks"]]) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(1, 2, [800, 800]), (1, 2, [800, 800]), (2, 0, [])]
    assert decontaminate.remove(df, bench).columns == df.columns


def test_op7_has_a_row_for_each_document(spark, tmp_path):
    leak = "one two three four five six seven eight"
    spark.createDataFrame([(1, f"so {leak} it is"), (2, "nothing of that kind"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, leak), (None, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["leaks"]) for r in queries.op7_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 2, "null:8/8,7:8/8"), 2: (False, 0, ""), 3: (False, 0, "")}


# --- on the tables ----------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    with duckdb.connect() as c:
        for t in ("documents", "pages"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        expected = c.sql(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= kept and len({r["doc_id"] for r in rows}) == len(rows)
        docs, kept = spark.createDataFrame(rows, docs.schema), {r["doc_id"] for r in rows}
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.collect()} == kept and last.where("not round_trip").count() == 0

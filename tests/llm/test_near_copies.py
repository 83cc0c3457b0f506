"""op2 and op3 against brute force, with all their ways for large inputs forced on small ones."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sensegauge.llm import components, line_dedup, ngram_join, shared


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_join(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return sorted(((d, len(s), min(ids[find(i)]) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def documents(seed, n=350):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    base, rows = [[random.choice(words) for _ in range(random.choice([5, 20, 40, 80, 120]))] for _ in range(15)], []
    for i in range(n):
        b = list(random.choice(base[: random.choice([1, 3, 15])]))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            j, op = random.randrange(len(b)), random.random()
            b[j : j + 1] = [random.choice(words)] if op < 0.5 else [] if op < 0.75 else [b[j], random.choice(words)]
            b = b or ["x"]
        rows.append((i, " ".join(b)))
    return rows + [(1000, ""), (1001, None), (1002, "a b"), (1003, "A b"), (1004, "a"), (1005, "  ")]


@pytest.mark.parametrize("forced", [False, True])
@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, monkeypatch, forced, k, percent):
    if forced:
        for name, value in {"BANDED": 3, "ROUNDS": 1, "CROWDED": 4, "BLOCK": 7, "HUB_KEYS": 1}.items():
            monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(components, "FEW_EDGES", 3)
        monkeypatch.setattr(shared, "HOT_ROWS", 10)
        monkeypatch.setattr(ngram_join, "STRETCH", 100)
    rows = documents(k + forced)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, unit string, n int")
    assert sorted((tuple(r) for r in ngram_join.join(df, k, percent).collect()), key=str) == brute_join(rows, k, percent)


def test_join_of_repeated_rows_and_no_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "z y x w v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.join(df, 3, 90).collect()), key=str) == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (7, 3, 5), (7, 3, 7)], key=str)
    assert ngram_join.join(df.where("false"), 3, 90).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect()), key=str)
    assert kept == sorted([(5, "a b c d e"), (None, "a b c d e"), (7, "a b c d e")], key=str)


def template_documents(n):
    """Pages of one template, of which few are near copies of each other; and copies of passages of it in any mixture."""
    random.seed(n)
    words = [f"w{i}" for i in range(3000)]
    template = [random.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        own = [random.choice(words) for _ in range(random.choice([20, 30]))]
        rows.append((2 * i, " ".join(template[:30] + own + template[30:])))
        if i % 5 == 0:
            own[random.randrange(len(own))] = "changed"
            rows.append((2 * i + 1, " ".join(template[:30] + own + template[30:])))
    return rows


def test_join_of_pages_of_one_template(spark, monkeypatch):
    """Crowded postings get new keys, under which next to no pairs are left to be tested."""
    for name, value in {"CROWDED": 8, "BLOCK": 20, "HUB_KEYS": 1}.items():
        monkeypatch.setattr(ngram_join, name, value)
    seen, own = [], ngram_join._crowds

    def counted(*a):
        found = own(*a)
        seen.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_crowds", counted)
    rows = template_documents(150)
    got = sorted((tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == brute_join(rows, 3, 90)
    assert seen and seen[0] <= 60  # of 16,000 pairs


def test_join_of_pages_whose_every_window_is_frequent(spark, monkeypatch):
    """With many pages each window is in several of them, so keys are of those windows that the fewest pages have."""
    for name, value in {"CROWDED": 8, "BLOCK": 20, "HUB_KEYS": 1}.items():
        monkeypatch.setattr(ngram_join, name, value)
    seen, own = [], ngram_join._blocks

    def counted(under, near, percent, anew=None):
        if anew is None:
            seen.append(under.count())
        return own(under, near, percent, anew)

    monkeypatch.setattr(ngram_join, "_blocks", counted)
    random.seed(4)
    template = [f"w{i}" for i in range(60)]
    parts = [[f"p{i}-{j}" for j in range(6)] for i in range(60)]
    rows = [(i, " ".join([*template[:30], *(w for p in random.sample(parts, 6) for w in p), *template[30:]])) for i in range(120)]
    rows += [(200 + i, t.replace("w3 ", "x ", 1)) for i, t in rows[::9]]
    got = sorted((tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=str)
    assert got == brute_join(rows, 3, 90)
    assert seen and seen[0] < 100  # units under crowded keys of the new order


def test_join_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, long.replace("w5 ", "x ", 1)), (4, "a " * 100_000), (5, "a " * 50_000)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit(1), "Keys": F.lit("k"), "n": F.lit(2)}), 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_percent_that_keys_cannot_serve(spark):
    with pytest.raises(ValueError):
        ngram_join.join(spark.createDataFrame([], "doc_id long, text string"), 3, 50)


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    random.seed(few)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_edit(a, b):
    """Whether one of all single edits of a, or none, makes b."""
    less = [a[:i] + a[i + 1 :] for i in range(len(a))]
    return a == b or b in less or a in [b[:i] + b[i + 1 :] for i in range(len(b))] or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def brute_lines(rows, near_words):
    lines = [(d, i, x) for d, t in rows if d is not None for i, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.BLANK)]
    first: dict = {}
    for d, i, x in lines:
        first[x] = min(first.get(x, (d, i)), (d, i))
    words = {x: re.findall(r"[^\x20\x09-\x0D]+", x) for x in first}
    long = [x for x in first if len(words[x]) >= near_words]
    near = {a for a in long if any(first[b] < first[a] and abs(len(words[a]) - len(words[b])) < 2 and brute_edit(words[a], words[b]) for b in long)}
    gone = collections.defaultdict(dict)
    for d, i, x in lines:
        if (d, i) > first[x] or x in near:
            gone[d][i] = not (d, i) > first[x]
    out = []
    for d, t in rows:
        own, g = t.split("\n") if t is not None else [], gone.get(d, {})
        out.append((d, "\n".join(x for i, x in enumerate(own) if i not in g) if t is not None else None, sum(bool(x.strip(line_dedup.BLANK)) for x in own), sum(not v for v in g.values()), sum(g.values())))
    return sorted(out, key=str)


def line_documents(seed):
    random.seed(seed)
    pool = ["a", "b", "é", "漢字", "xyz", "0", "A", "a\u00a0b", "long-word", "."]
    base = [[random.choice(pool) for _ in range(random.choice([1, 2, 4, 9, 10, 11, 12, 20, 60]))] for _ in range(30)] + [["a"] * 12, ["a", "b"] * 6]

    def edited(w):
        w = list(w)
        for _ in range(random.choice([0, 1, 1, 2])):
            j, op = random.randrange(len(w)), random.random()
            w[j : j + 1] = [random.choice(pool)] if op < 0.4 else [] if op < 0.7 else [random.choice(pool), w[j]]
            w = w or ["q"]
        return random.choice([" ", " ", " ", "  ", "\t"]).join(w) + random.choice(["", "", " ", "\r"])

    rows = [(i, "\n".join(edited(random.choice(base)) if random.random() < 0.8 else random.choice(["", "x", "   ", f"a line of document {i} with {random.random()}"]) for _ in range(random.choice([0, 1, 3, 9])))) for i in range(110)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (None, rows[3][1]), (3, rows[3][1]), (5, "another\n" + " ".join(base[5] * 3)), (503, rows[3][1] + "\n"), (504, "long " * 20_000), (505, "long " * 20_001)]


@pytest.mark.parametrize("hot, near_words", [(False, 10), (True, 10), (False, 2), (True, 1)])
def test_line_dedup_against_brute_force(spark, monkeypatch, hot, near_words):
    if hot:
        monkeypatch.setattr(shared, "HOT_ROWS", 3)
        monkeypatch.setattr(line_dedup, "MAX_SENT", 10)
        monkeypatch.setattr(line_dedup, "few", lambda df, most=0: False)
    rows = line_documents(hot + near_words)
    df = spark.createDataFrame([(a, b, "x", len(b or ""), "y") for a, b in rows], "doc_id long, text string, gone string, n_chars long, N_Exact string")
    found = line_dedup.dedup(df, near_words)
    assert found.columns == ["doc_id", "text", "gone", "n_chars", "n_lines", "n_exact", "n_near"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in found.collect()), key=str) == brute_lines(rows, near_words)


def test_clean_drops_emptied_documents_only(spark):
    df = spark.createDataFrame([(1, "one line\nanother line", 1), (2, "one line", 1), (3, "", 0), (4, "another line\nnew", 9)], "doc_id long, text string, n_chars int")
    assert sorted(tuple(r) for r in line_dedup.clean(df).collect()) == [(1, "one line\nanother line", 1), (3, "", 0), (4, "new", 3)]
    assert line_dedup.clean(df.where("false")).count() == 0
    clash = df.withColumns({"n_lines": F.lit("own"), "row": F.lit(5), "rest": F.lit("r")})
    assert line_dedup.clean(clash).columns == clash.columns and {r["n_lines"] for r in line_dedup.clean(clash).collect()} == {"own"}


def test_row_without_id_links_two_documents(spark):
    words = [f"w{i}" for i in range(48)]
    text = lambda a: " ".join(words[a : a + 40])
    df = spark.createDataFrame([(1, text(0)), (None, text(4)), (2, text(8)), (3, "another text of its own")], "doc_id bigint, text string")
    component = lambda rows: {r["doc_id"]: r["component_id"] for r in ngram_join.join(rows, 3, 75).collect()}
    assert component(df.where("doc_id is not null")) == {1: 1, 2: 2, 3: 3}
    got = component(df)
    assert got[1] == got[2] == 1 and got[3] == 3

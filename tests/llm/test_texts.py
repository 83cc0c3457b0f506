"""op1, op5, op8, op9, op10 on texts: against brute force, exact round trips and held-out accuracy; and odd inputs."""

import hashlib
import os
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sensegauge.llm import licenses, pieces, quality, queries, token_counts, toxicity

ODD = [(None, "The cat."), (1, None), (2, ""), (2, ""), (3, "  \n\t "), (4, "word " * 30_000), (5, "x" * 200_000), (6, "É漢🙂 .!?"), (7, "All rights reserved. token = 'abcdefgh12'")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, "h" if a != 3 else None, 1.0, 2, "q") for a, b in ODD], "doc_id long, text string, source string, score double, n int, spans string")


# --- op1 --------------------------------------------------------------------------------------------------------------


def toxic_rows(n, seed):
    random.seed(seed)
    words = ["".join(random.choice(["an", "er", "ti", "on", "sh", "le", "ou"]) for _ in range(random.randint(1, 4))) for _ in range(500)]
    rows = []
    for i in range(n):
        own = [random.choice(words) for _ in range(random.randint(1, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(random.randint(1, 4)):
                own.insert(random.randrange(len(own) + 1), random.choice(["grumpf", "Blortch", "zwack" + random.choice(words)]))
        rows.append((i, ". ".join(" ".join(own[j : j + 9]) for j in range(0, len(own), 9)), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = toxic_rows(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [r for r in rows if crc32(str(r[0]).encode()) % 4 == 2]
    right = sum((got[i]["score"] >= toxicity.THRESHOLD) == bool(y) for i, _, y in held)
    assert right / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    for i, t, y in held:
        for s in got[i]["spans"]:
            assert re.match(r"(grumpf|blortch|zwack)", t[s["start"] : s["stop"]].lower())
    kept = toxicity.reject(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r["score"] < toxicity.THRESHOLD for r in got.values())


def test_held_out_labels_are_not_used(spark):
    rows = toxic_rows(400, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1 - y if crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a, b = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], flip))
    assert (a.weights == b.weights).all() and (a.calibration == b.calibration).all()
    assert docs.select(toxicity.held_out(F.col("doc_id")).alias("h"), "doc_id").where("h").count() == sum(crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows)


def test_chain_against_all_paths():
    import itertools

    import numpy as np

    random.seed(3)
    sizes = np.array([1, 4, 2, 6])
    e, move = np.array([random.gauss(0, 2) for _ in range(13)]), np.array([0.3, -0.7, 1.1])
    p, r, q = toxicity.Chain(sizes).run(e, move)
    expected, counts, at = [], np.zeros(3), 0
    for n in sizes.tolist():
        weights, ones = 0.0, np.zeros(n)
        own = np.zeros(3)
        for path in itertools.product((0, 1), repeat=n):
            s = sum(e[at + i] for i, y in enumerate(path) if y)
            moves = Counter(zip(path, path[1:]))
            m = np.array([moves[0, 1], moves[1, 0], moves[1, 1]])
            w = np.exp(s + (m * move).sum())
            weights, ones, own = weights + w, ones + w * np.array(path), own + w * m
        expected.extend(ones / weights)
        counts, at = counts + own / weights, at + n
    assert p == pytest.approx(expected) and toxicity.Chain(sizes).moves(e, move, r, q) == pytest.approx(counts)


def test_toxicity_of_odd_input(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(odd, toxicity.learn(odd, none)).collect()] == pytest.approx([0] * len(ODD), abs=1e-6)
    rows = toxic_rows(300, 4)
    model = toxicity.fit([r[1:] for r in rows])
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(odd.where("false"), model).count() == 0


def test_a_model_that_tells_nothing_apart_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(9)], "doc_id long, toxic int")
    assert toxicity.reject(docs, labels).count() == 9


def test_long_sentences_are_fitted_in_runs():
    import numpy as np

    begins, sizes = toxicity.runs(np.array([0, 5, 1005]), np.array([5, 1000, 400]), 400)
    assert begins.tolist() == [0, 5, 405, 805, 1005] and sizes.tolist() == [5, 400, 400, 200, 400]
    rows = [(t.replace(".", ""), y) for _, t, y in toxic_rows(400, 6)]
    model = toxicity.fit([(" ".join([t] * 40), y) for t, y in rows])
    assert len(model.codes)


def test_the_fit_has_the_tokens_of_a_slice_at_once(monkeypatch):
    import tracemalloc

    rows = [(" ".join([t] * 30), y) for _, t, y in toxic_rows(400, 7)]
    tracemalloc.start()
    model = toxicity.fit(rows, steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.codes) and peak < 30 * sum(len(t) for t, _ in rows)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 1000)
    other = toxicity.fit(rows, steps=5)
    assert (model.codes == other.codes).all() and (model.weights == other.weights).all() and (model.calibration == other.calibration).all()


def test_free_memory_of_the_drivers_jvm_is_given_back(spark):
    from sensegauge.llm import shared

    assert "native heap" in shared.trim_jvm(spark)


# --- op5 --------------------------------------------------------------------------------------------------------------


def test_edits_count_as_encoding_anew(spark):
    class Sent:
        value = token_counts.read_ranks()

    count = token_counts.counter(Sent)
    random.seed(3)
    letters = ["a", " ", "  ", "\n", "'s", "1", "é", "don't", " x", "\t", "!", "\u00a0", "漢字", "。", "'", "\u0301", "²", "一", "\x1c", "€", "का", "🙂", "\u200b", "\u3000"]
    for k in range(400):
        text = "".join(random.choice(letters) for _ in range(random.choice([0, 3, 40, 3000])))
        own = token_counts.segments(text)
        tree = token_counts.Tree(own, [count(s) for s in own], count)
        assert "".join(own) == text and tree.tokens[1] == count(text)
        for _ in range(5):
            a = random.randint(-1, len(text) + 2)
            b, new = random.choice([a, a + random.randint(0, 5), a + random.randint(0, 3000)]), "".join(random.choice(letters) for _ in range(random.choice([0, 1, 10, 6000 if k % 40 == 0 else 2])))
            lo, hi = sorted((min(max(0, a), len(text)), min(max(0, b), len(text))))
            text = text[:lo] + new + text[hi:]
            tree.edit(a, b, new)
            assert "".join(t for t, _ in tree.leaves()) == text and tree.tokens[1] == count(text)


def test_text_without_spaces_is_cut(spark):
    sent = token_counts.ship(spark, token_counts.read_ranks())
    text = "漢字，字漢字。" * 2500
    assert max(map(len, token_counts.segments(text))) < token_counts.SEGMENT + 10
    docs = spark.createDataFrame([(1, text, "own", [(9000, 9001, "x")])], "doc_id long, text string, Tree string, edits array<struct<start: int, stop: int, replacement: string>>")
    got = token_counts.edit(token_counts.build(docs, sent), sent).first()
    assert got["n_tokens"] == token_counts.counter(sent)(text[:9000] + "x" + text[9001:]) and 0 < got["encoded"] < 500


def test_only_what_edits_touch_is_encoded(spark):
    sent = token_counts.ship(spark, token_counts.read_ranks())
    docs = spark.createDataFrame([(1, "some words here " * 2000), (2, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 16_000, 16_004, "new"), (1, 1, 9000, 9000, "more"), (3, 1, 0, 0, "x")], "doc_id long, seq int, start int, stop int, replacement string")
    got = {r["doc_id"]: r for r in token_counts.edit(token_counts.with_edits(token_counts.build(docs, sent), edits), sent).collect()}
    assert 0 < got[1]["encoded"] < 2000 and got[1]["n_edits"] == 2 and got[2]["n_tokens"] == 0
    text = ("some words here " * 2000)[:9000] + "more" + ("some words here " * 2000)[9000:]
    text = text[:16_000] + "new" + text[16_004:]
    assert got[1]["text"] == text and got[1]["n_tokens"] == token_counts.counter(sent)(text)
    again = token_counts.build(spark.createDataFrame([(1, text)], "doc_id long, text string"), sent).first()["tree"]
    assert sum(x["tokens"] for x in again) == sum(x["tokens"] for x in got[1]["tree"])


# --- op8 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_the_librarys(library, monkeypatch):
    codec = pieces.Codec(pieces.Vocabulary.read())
    random.seed(1)
    letters = [" ", "  ", "\n", "a", "b", "th", "e", "é", "漢", "▁", "\t", "1", "2", "ing", "tion", "of", " the", "A", "!", "🙂", "².", "²", "=", "--"]
    rows = ["".join(random.choice(letters) for _ in range(random.choice([0, 1, 5, 40, 300]))) for _ in range(600)] + [" " * n for n in range(1, 40)] + ["a" * 500, "ab" * 400, "=" * 100 + " " * 40 + "x"]
    for k, x in enumerate(rows):
        ids = library.encode(x)
        assert list(memoryview(codec.encode(x)).cast("i")) == ids, x
        if k == 300:
            monkeypatch.setattr(pieces, "WORDS", 20)
            monkeypatch.setattr(pieces, "PAIRS", 20)
        if x:
            assert [i for part in codec.search("▁" + x.replace(" ", "▁")) for i in part] == ids
        assert codec.decode(ids) == x.replace("▁", " ")


def test_the_window_does_not_follow_the_length_of_a_word(library):
    codec = pieces.Codec(pieces.Vocabulary.read())
    random.seed(5)
    word = "".join(random.choice(["ing", "un", "th", "e", "r", "é", "漢"]) for _ in range(1000))
    ids = library.encode(word * 20)
    assert list(memoryview(codec.encode(word * 20)).cast("i")) == ids
    long = word * (10_000_000 // len(word))
    n, longest = 0, 0
    for part in codec.search(long):
        n, longest = n + len(part), max(longest, len(part))
    assert len(ids) / len(word * 20) == pytest.approx(n / len(long), rel=1e-3)
    assert codec.window <= (2 * pieces.STEP + 2) * codec.longest and longest <= codec.window * 4


def test_a_place_is_settled_by_the_first_piece_that_fits(library):
    """A place has one path, so no other piece that ends there is asked for once one fits."""
    codec = pieces.Codec(pieces.Vocabulary.read())
    word = "▁internationalizationandcounterrevolutionarieswithoutunderstanding"
    assert [i for part in codec.search(word) for i in part] == library.encode(word[1:])
    lasts = [-1, *(library.encode(word[1:j])[-1] for j in range(2, len(word) + 1))]
    lasts.insert(1, codec.ids["▁"])
    ends = {(lasts[i], codec.ids[word[i:j]]) for j in range(1, len(word) + 1) for i in range(j) if word[i:j] in codec.ids}
    assert codec.n_pairs < 0.8 * len(ends)


def test_parts_of_a_text_are_cut_where_paths_meet(library, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 7)
    codec = pieces.Codec(pieces.Vocabulary.read())
    random.seed(6)
    for _ in range(200):
        x = "".join(random.choice([" ", "  ", "ab", "the", "▁", ".", "é", "\n", "of "]) for _ in range(40))
        assert list(memoryview(codec.encode(x)).cast("i")) == library.encode(x)


def test_unigram_search_finds_the_best_path():
    random.seed(2)
    pool = ["".join(random.choice("ab") for _ in range(random.randint(2, 4))) for _ in range(12)]
    names = ["<unk>", "a", "b", *sorted(set(pool))]
    scores = [0.0, -3.0, -3.5, *(-random.uniform(1, 6) for _ in names[3:])]
    codec = pieces.Codec(pieces.Vocabulary(names, scores, {0}, {}, 0, False))
    for n in (1, 5, 30, 200):
        text = "".join(random.choice("ab") for _ in range(n))
        best = [0.0] + [-1e9] * n
        for j in range(1, n + 1):
            best[j] = max(best[j - len(p)] + s for p, s in zip(names[1:], scores[1:], strict=True) if text[:j].endswith(p))
        ids = [i for part in codec.search(text) for i in part]
        assert "".join(names[i] for i in ids) == text and sum(scores[i] for i in ids) == pytest.approx(best[n])


def test_round_trip(spark, odd):
    sent = pieces.ship(spark, pieces.Vocabulary.read())
    one, two = pieces.encode(odd, sent, decoded=True), pieces.decode(pieces.encode(odd, sent), sent)
    for found in (one, two):
        assert all(r["decoded"] == (r["text"] or "") for r in found.collect())
    assert pieces.encode(odd.where("false"), sent).count() == 0
    clash = odd.withColumns({"ids": F.lit("own"), "Decoded": F.lit(1)})
    assert pieces.encode(clash, sent, decoded=True).where("decoded <> coalesce(text, '')").count() == 0
    assert pieces.decode(pieces.encode(clash, sent), sent).where("decoded <> coalesce(text, '')").count() == 0


# --- op9, op10 --------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def test_base_license_places_against_brute_force(spark):
    random.seed(8)
    bits = ["cc by", "CC-BY", "general public license", "All rights\nreserved", "mit license", "licensed under the", "x", "cc", "by", "4.0", "é", "apache license version 2.0"]
    rows = [(i, " ".join(random.choice(bits) for _ in range(random.choice([0, 1, 4, 30])))) for i in range(300)] + [(900, None)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = words_of(rows[r["doc_id"]][1] if r["doc_id"] < 900 else None)
        places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.encode().split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), ("nothing here", ""), ("mit dem Hund", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"), ("GPL-3.0", "gpl-3.0"), ("CC BY-SA 4.0", "cc-by,cc-by-sa"),
    ("SPDX-License-Identifier: MIT", "mit"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
])
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == labels


def test_license_rules_are_many_and_their_gates_lose_nothing():
    """Whatever an expression matches holds a word of each set of its gate."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from sensegauge.llm import license_rules

    written = [x for t in (license_rules.NOTICES, license_rules.RESERVATIONS, license_rules.NAMES) for x in license_rules._lines(t)]
    assert len(written) >= 200 and len({rx for *_, rx in written}) == len(written)
    every = licenses.rules()
    assert len({r.priority for r in every}) == len(every)

    @settings(max_examples=4, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.data())
    def holds(data):
        for rule in every:
            words = set(data.draw(st.from_regex(re.compile(rule.pattern, re.A), fullmatch=True)).split())
            assert all(words & one for one in rule.gate), rule

    holds()


def brute_licenses(text, every):
    """All rules without gates; then a detection stands unless one that goes before it, and stands, covers it."""
    joined = " " + " ".join(w.decode() for w in words_of(text)) + " "
    found = []
    for r in every:
        at = 0
        while m := re.compile(r.pattern).search(joined, at):
            found.append((joined[: m.start()].count(" "), joined[: m.end() - 1].count(" "), r))
            at = m.end() - 1
    found.sort(key=lambda s: (-s[2].priority, len(joined), s[0]))
    stands = []
    for a, b, r in found:
        if not any(c <= a and b <= d for c, d, _ in stands):
            stands.append((a, b, r))
    return sorted((a, b, r.label) for a, b, r in stands)


def test_licenses_against_brute_force(spark):
    random.seed(11)
    every = licenses.rules()
    bits = ["Licensed under the", "distributed under the terms of the", "SPDX-License-Identifier:", "GPL", "gnu general public license", "version 3", "v2.0", "MIT", "License", "apache", "2.0", "cc by", "nc", "sa", "4.0 international", "all rights reserved", "worldwide", "Copyright (c) 2020", "by", "public domain", "in the", "x", "é", "permission is hereby granted free of charge to any person obtaining", "a copy of this software", "mozilla public license", "lesser", "affero", "as is"]
    rows = [(i, " ".join(random.choice(bits) for _ in range(random.choice([1, 5, 20, 60])))) for i in range(150)] + [(900, None), (None, "MIT License"), (901, ""), (902, "MIT License " * 3000), (902, "MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"labels": F.lit("own"), "Score": F.lit(1), "spans": F.lit(2)})
    got = sorted(((r["doc_id"], r["spans"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(d, ",".join(f"{label}:{a}:{b}" for a, b, label in brute_licenses(t, every))) for d, t in rows if t is None or len(t) < 10_000] + [(902, ",".join(f"mit:{2 * i}:{2 * i + 2}" for i in range(3000)))], key=str)
    assert licenses.scan(df.where("false")).count() == 0


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g, repeated = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if g[tuple(w[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_against_brute_force(spark, odd):
    random.seed(9)
    bits = ["a", "b", "c é", "\n", "\n\n", "#", "the same line\n", "a a a", "漢$", "\t", "  x"]
    rows = [(i, " ".join(random.choice(bits) for _ in range(random.choice([0, 2, 20, 90]))), f"h{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(odd.select("doc_id", "text", "source"))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(df).collect())
    expected = Counter((d, *q, q[0] < 50 or 100 * q[4] > 50 * q[0]) for d, t, *_ in [*rows, *ODD] for q in [brute_quality(t)])
    assert got == expected
    assert quality.judge(df.where("false")).count() == 0


def test_host_verdicts(spark, monkeypatch):
    """The same three texts on a trusted, a watched and a bad host: what stays is up to the host."""
    good = " ".join(f"word{i}" for i in range(60))
    listed = " ".join(f"word{i}" + ("|" if i % 3 == 0 else "") for i in range(60))
    junk = " ".join(f"word{i}###" for i in range(60))
    rows = [(10_000 * h + i, "short" if i < bad else good, host) for h, (host, bad) in enumerate((("trusted", 1), ("watched", 30), ("bad", 85), (None, 1))) for i in range(100)]
    rows += [(100_000 * (j + 1) + h, t, host) for j, t in enumerate((good, listed, junk)) for h, host in enumerate(("trusted", "watched", "bad", None))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit("own"), "kept": F.lit(1), "n": F.lit(2)})
    for few in (quality.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(quality, "BROADCAST_HOSTS", few)
        got = {r["doc_id"]: r for r in quality.judge(df).collect()}
        assert len(got) == len(rows) and not got[0]["kept"]
        assert [[got[100_000 * (j + 1) + h]["kept"] for h in range(4)] for j in range(3)] == [[True] * 4, [True, True, False, True], [True, False, False, True]]
        assert got[0]["host_rate"] < quality.WATCHED_RATE < got[10_000]["host_rate"] < quality.MAX_HOST_RATE < got[20_000]["host_rate"] < 86 / 102


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_host_verdicts_decide_on_the_tables(spark):
    """Documents that only go by their host's verdict, on tables where all hosts are watched."""
    got = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed and not kept").collect()
    assert got and all(2 * r["n_symbols"] > r["n_words"] and quality.WATCHED_RATE < r["host_rate"] < quality.MAX_HOST_RATE for r in got)


def test_beta_prior():
    assert quality.beta_prior(0, None, None, None, None) == (0.0, 1.0)
    assert quality.beta_prior(1, 10.0, 5.0, 100.0, 2.5) == (0.5, 10.0)
    same = quality.beta_prior(4, 400.0, 100.0, 40_000.0, 4 * 25 * 25 / 100)
    assert same == (0.25, 400.0)
    mean, strength = quality.beta_prior(2, 200.0, 100.0, 20_000.0, (90 * 90 + 10 * 10) / 100)
    assert mean == 0.5 and 1 <= strength < 5


def test_digests_of_queries(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    r = {x["doc_id"]: x for x in queries.op6_secrets(spark, str(tmp_path)).collect()}
    assert r[7]["spans"] == "assign:21:40" and r[7]["base_sha256"] == hashlib.sha256(b"assign:21:40").hexdigest()
    assert r[2]["spans"] == "" and r[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and r[5]["n_hex"] == 0
    assert len(queries.op8_sentencepiece(spark, str(tmp_path)).where("round_trip").collect()) == len(ODD)
    assert queries.op5_token_counts(spark, str(tmp_path)).count() == len(ODD)

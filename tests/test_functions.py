"""Column functions and plain metrics against hand-computed values, plain versions and identities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sensegauge.functions import overlap, stats, text
from sensegauge.functions.vectors import cosine


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("score, passed", [
    (95.49, ""), (95.5, "95"), (99.5, "95 99 100"), (100.5, "95 99 100"), (100.51, "95 99"), (0.5, "1 5 0"), (4.5, "5"), (-0.5, "1 5 0"), (-3.0, "1 5"), (float("nan"), None),
])
def test_thresholds_are_strict_after_rounding_half_to_even(spark, score, passed):
    s = F.lit(score)
    tests = {"95": stats.ABOVE["ratio_95"], "99": stats.ABOVE["ratio_99"], "100": stats.ABOVE["ratio_equals"], "1": stats.BELOW["ratio_1"], "5": stats.BELOW["ratio_5"], "0": stats.BELOW["ratio_equals"]}
    row = spark.range(1).select(*(f(s).alias(k) for k, f in tests.items())).first().asDict()
    if passed is None:
        assert set(row.values()) == {None}
    else:
        assert {k for k, v in row.items() if v} == set(passed.split())


def test_statistics(spark):
    rows = [(90.0, 80.0), (10.0, 30.0), (55.0, 40.0), (70.0, 95.0), (float("nan"), 5.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "p double, y double")
    p, y = F.col("p"), F.col("y")
    got = df.agg(stats.pearson(p, y), stats.r2(p, y), stats.rmse(p, y), stats.mean(p), stats.stdev(p), stats.stdev(p, True), stats.pairs(p, y)).first()
    use = rows[:4]
    my, mp = sum(b for _, b in use) / 4, sum(a for a, _ in use) / 4
    sst, ssr = sum((b - my) ** 2 for _, b in use), sum((b - a) ** 2 for a, b in use)
    var = sum((a - mp) ** 2 for a, _ in use)
    r = sum((a - mp) * (b - my) for a, b in use) / math.sqrt(var * sst)
    assert got[:4] == pytest.approx((r, 1 - ssr / sst, math.sqrt(ssr / 4), mp))
    assert got[4:6] == pytest.approx((math.sqrt(var / 3), math.sqrt(var / 4)))
    assert got[6] == 4


@pytest.mark.parametrize("rows", [[], [(1.0, 100.0)], [(1.0, 100.0), (2.0, 100.0)]])
def test_undefined_statistics_are_null(spark, rows):
    df = spark.createDataFrame(rows, "p double, y double")
    r, r2 = df.agg(stats.pearson(F.col("p"), F.col("y")), stats.r2(F.col("p"), F.col("y"))).first()
    assert r is None and r2 is None
    if len(rows) < 2:
        assert one(df.agg(stats.stdev(F.col("p")))) is None


def test_null_scores_do_not_count_as_failed(spark):
    df = spark.createDataFrame([(100.0,), (None,)], "s double")
    assert one(df.agg(stats.share(stats.ABOVE["ratio_95"](F.col("s"))))) == 100


@pytest.mark.parametrize("r, n", [(0.5, 10), (0.0, 20), (-0.9, 5), (0.05, 300), (0.3, 3)])
def test_pvalue_against_numeric_integration(r, n):
    """The density of r under no correlation is proportional to (1 - x^2)^((n - 4) / 2); x = sin u keeps it smooth."""
    density = lambda u: math.cos(u) ** (n - 3)
    steps = 20_000
    area = lambda a, b: sum(density(a + (b - a) * (i + 0.5) / steps) for i in range(steps)) * (b - a) / steps
    assert stats.pearson_p(r, n) == pytest.approx(area(math.asin(abs(r)), math.pi / 2) / area(0, math.pi / 2), rel=1e-6)


def test_pvalue_at_the_edges():
    assert stats.pearson_p(1.0, 9) == 0.0 and stats.pearson_p(0.3, 2) is None and stats.pearson_p(None, 9) is None and stats.pearson_p(float("nan"), 9) is None


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [100.0, 0.0, None, None]


def test_words_sentences_and_ngrams(spark):
    df = spark.createDataFrame([("Ärger, it's 2 p.m.! ok",), ("one",), ("",), (None,)], "t string")
    t = F.col("t")
    got = df.select(text.words(t), text.sentences(t), text.ngrams(text.words(t), 2), text.fkgl(t)).collect()
    assert got[0][0] == ["ärger", "it", "s", "2", "p", "m", "ok"]
    assert got[0][1] == [" Ärger, it's 2 p", " m", " ok"]
    assert got[0][2][:2] == ["ärger it", "it s"]
    assert got[1][2] == [] and got[2][0] == [] and got[2][3] is None and got[3][3] is None


def test_parse_bool(spark):
    assert [r[0] for r in spark.createDataFrame([("True",), ("no",)], "x string").select(text.parse_bool(F.col("x"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(text.parse_bool(F.col("x"))).collect()


def test_golden_values():
    a, b = "the cat sat on the mat".split(), "the cat the mat".split()
    assert overlap.rouge_n(a, b, 1) == pytest.approx(80.0)
    assert overlap.rouge_n(a, b, 2) == pytest.approx(100 * 2 * 2 / (5 + 3))
    assert overlap.rouge_l(a, b) == pytest.approx(80.0)
    assert overlap.bleu(a, b) == pytest.approx(100 * math.exp(1 - 6 / 4) * (1 * (2 / 3) * (1 / 4) * (1 / 4)) ** 0.25)
    assert overlap.meteor_exact(a, a) == pytest.approx(100 * (1 - 0.5 / 6**3))
    assert overlap.ter("a b c d".split(), "c d a b".split()) == pytest.approx(25.0)  # one shift
    assert overlap.ter("a b c d".split(), "a x c".split()) == pytest.approx(50.0)
    assert overlap.sari(a, a, [a]) == pytest.approx(100.0)


def test_identities():
    random.seed(5)
    for _ in range(200):
        a, b = ([random.choice("abcde") for _ in range(random.randint(1, 12))] for _ in range(2))
        assert overlap.bleu(a, a) == pytest.approx(100) and overlap.rouge_l(a, a) == pytest.approx(100) and overlap.ter(a, a) == 0
        sari, bleu = overlap.sari(a, b, [a]), overlap.bleu(a, b)
        assert 0 <= sari <= 100.0001 and 0 <= bleu <= 100.0001 and math.sqrt(sari * bleu) <= (sari + bleu) / 2 + 1e-9


def test_alignments_against_plain_programmes():
    random.seed(6)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 15))] for _ in range(2))
        n, m = len(a), len(b)
        c, d = ([[0] * (m + 1) for _ in range(n + 1)] for _ in range(2))
        for i in range(n + 1):
            for j in range(m + 1):
                d[i][j] = max(i, j) if not i or not j else min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i and j:
                    c[i][j] = c[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(c[i - 1][j], c[i][j - 1])
        assert overlap.lcs(a, b) == c[n][m] and overlap._distance(a, b) == d[n][m]
        if a:
            assert overlap.ter(a, b) <= 100 * d[n][m] / n + 1e-9


def _plain_ter(reference, prediction, words=10, far=50, most=1000):
    """Shifts measured one by one."""
    best, hyp, shifts = overlap._distance(prediction, reference), list(prediction), 0
    while True:
        found, tried = None, 0
        for i in range(len(hyp)):
            for j in (j for j, w in enumerate(reference) if w == hyp[i]):
                if i == j or abs(i - j) > far or (j < len(hyp) and hyp[j] == reference[j]) or tried >= most:
                    continue
                n = next((n for n in range(words) if i + n >= len(hyp) or j + n >= len(reference) or hyp[i + n] != reference[j + n]), words)
                rest, tried = hyp[:i] + hyp[i + n :], tried + 1
                moved = rest[:j] + hyp[i : i + n] + rest[j:]
                key = (best - overlap._distance(moved, reference), n, -i)
                if key[0] > 0 and (found is None or key > found[0]):
                    found = key, moved
        if found is None:
            return 100 * (best + shifts) / len(reference)
        hyp, shifts, best = found[1], shifts + 1, best - found[0][0]


def test_shifts_that_are_measured_together(monkeypatch):
    monkeypatch.setattr(overlap, "FIRST", 2)
    monkeypatch.setattr(overlap, "TOGETHER", 5)
    rng = random.Random(11)
    for _ in range(150):
        a, b = ([f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert overlap.ter(a, b) == _plain_ter(a, b)
        assert overlap.ter(a, b, shifts_tried=3) == _plain_ter(a, b, most=3)


def test_many_unrelated_words_are_measured_in_few_steps(monkeypatch):
    """Texts of one kind share their common words: hundreds of shifts a round, of which none may take a table of its own."""
    tables, real = [], overlap._distance
    monkeypatch.setattr(overlap, "_distance", lambda a, b: tables.append(1) or real(a, b))
    rng = random.Random(3)
    a, b = ([f"w{int(rng.random() ** 3 * 60)}" for _ in range(120)] for _ in range(2))
    overlap.ter(a, b)
    assert len(tables) <= 1


def test_a_source_that_is_its_own_reference():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 12))] for _ in range(2))
        x, y = overlap.Text(a), overlap.Text(b)
        assert overlap.sari_own(x, y) == overlap.sari(a, b, [a])
        assert (overlap.bleu(x, y), overlap.rouge_n(x, y, 2)) == (overlap.bleu(a, b), overlap.rouge_n(a, b, 2))

"""Operators on small tables: metrics, summaries, runs, reports, coverage, sources and sinks, streaming."""

import pytest
from pyspark.sql import functions as F

from sensegauge.operators import coverage, metrics, pairs, runs, summary
from sensegauge.plans import evaluate, reports, train
from sensegauge.sources import sinks, tables
from sensegauge.sources.schemas import PAIRS
from sensegauge.streaming import run_log

TEXTS = [("the cat sat on the mat", "the cat sat"), ("one", "one"), ("", "x"), (None, "x"), ("a b c d e", "v w x y z")]


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(i, "test", a, b, float(10 * i)) for i, (a, b) in enumerate(TEXTS)], "pair_id bigint, split string, original string, simplification string, label double")


def test_scores(table):
    rows = {r["pair_id"]: r for r in metrics.score(table, metrics.without_model()).collect()}
    assert rows[2]["BLEU"] is None and rows[3]["SARI"] is None and rows[4]["BLEU"] == 0 and rows[4]["BLEU-SARI (GM)"] == 0
    for i in (0, 1, 4):
        assert rows[i]["IBLEU"] == pytest.approx(0.8 * rows[i]["BLEU"])
    assert rows[1]["BLEU"] == pytest.approx(100) and rows[1]["FKBLEU"] == pytest.approx(40) and rows[1]["ROUGE-L"] == pytest.approx(100)


def test_derived_only_keeps_what_was_asked_for(table):
    assert metrics.score(table, ["IBLEU"]).columns == [*table.columns, "IBLEU"]


def test_no_score_is_made_up(table):
    with pytest.raises(metrics.ModelUnavailable):
        metrics.score(table, ["BLEURT"])
    with pytest.raises(ValueError):
        metrics.score(table, ["NONE"])


def test_registered_model(table):
    metrics.use_model("LENS", lambda o, s: F.length(s).cast("double"))
    try:
        assert metrics.score(table, ["LENS"]).where("pair_id = 1").first()["LENS"] == 3
    finally:
        metrics._MODELS.clear()


def test_summaries_of_three_kinds(spark, table):
    both = table.unionByName(pairs.identical(table, "pair_id", "original")).unionByName(pairs.unrelated(table, "pair_id", "original"))
    got = {(r["split"], r["metric"], r["stat"]): r["value"] for r in evaluate.benchmark_metrics(both).collect()}
    assert got["same_sentence", "ROUGE-1", "ratio_95"] == 100 and got["same_sentence", "IBLEU", "ratio_95"] == 0
    for metric in metrics.without_model():
        if metric != "FKGL":
            a, b, c = (got["same_sentence", metric, k] for k in ("ratio_95", "ratio_99", "ratio_equals"))
            assert a >= b >= c
    assert not any(s != "test" and m == "FKGL" for s, m, _ in got) and ("test", "FKGL", "R2") in got
    assert {k for s, m, k in got if s == "test" and m == "BLEU"} == {"pearson_corr", "pearson_pvalue", "R2", "rmse", "mean", "st_dev"}


def test_model_summary_ties_mean_rmse_and_deviation(spark):
    df = spark.createDataFrame([(97.0, 100.0), (99.6, 100.0), (40.0, 100.0)], "prediction double, label double")
    r = summary.predictions(df, summary.IDENTICAL).first()
    assert r["rmse"] ** 2 == pytest.approx((r["mean"] - 100) ** 2 + r["st_dev"] ** 2)
    assert (r["ratio_95"], r["ratio_99"]) == (pytest.approx(200 / 3), pytest.approx(100 / 3))


def test_augmentation_is_symmetric(table):
    rows = {(r["original"], r["simplification"]) for r in pairs.augment(table).collect()}
    assert rows == {p for a, b in TEXTS for p in ((a, b), (b, a))}
    assert pairs.augment(table).where("pair_id = 1").count() == 1


def test_each_text_has_an_unrelated_one(spark, monkeypatch):
    # conversations of several turns, of one turn, and of more than 1,000; one text is very common
    rows = [(c * 1000 + t, c, f"text {c} {t}" if t else "hello") for c in range(40) for t in range(c % 4 + 1)] + [(50_000 + t, 50, f"long {t % 7}") for t in range(1200)] + [(1, 60, None)]
    df = spark.createDataFrame(rows, "key bigint, conv int, text string")
    conv, convs = {k: c for k, c, _ in rows}, {}
    for _, c, t in rows:
        convs.setdefault(t, set()).add(c)
    for size in (1000, 3):
        monkeypatch.setattr(pairs, "RANGE", size)
        got = pairs.unrelated(df, "key", "text", "conv").collect()
        assert sorted(r["pair_id"] for r in got) == sorted(k for k, _, t in rows if t is not None)
        assert all(r["simplification"] != r["original"] and convs[r["simplification"]] - {conv[r["pair_id"]]} for r in got)


@pytest.mark.parametrize(("rows", "paired"), [([], 0), ([(1, 1, "a")], 0), ([(1, 1, "a"), (2, 1, "b")], 0), ([(1, 1, "a"), (2, 2, "a")], 0), ([(1, 1, "a"), (2, 1, "b"), (3, 2, "a")], 2), ([(1, 1, "a"), (2, None, "b")], 2), ([(i, i // 9, f"{i % 2}") for i in range(12)], 12)])
def test_unrelated_of_few_rows(spark, paired, rows):
    assert pairs.unrelated(spark.createDataFrame(rows, "key bigint, conv int, text string"), "key", "text", "conv").count() == paired


RUNS = [("a", "finished", False, 500, "holdout fixed"), ("b", "finished", False, 500, "holdout fixed"), ("c", "running", False, 500, "holdout fixed"), ("d", "finished", True, 7, "x"), ("m", "finished", False, 250, "holdout fixed")]
LOG = [("a", 0, "test/BLEU_pearson_corr", 0.1), ("a", 1, "test/BLEU_pearson_corr", 0.5), ("b", 0, "test/BLEU_pearson_corr", 0.7), ("c", 0, "test/BLEU_pearson_corr", 9.0), ("d", 0, "test/BLEU_pearson_corr", 9.0), ("a", 0, "test/SARI_pearson_corr", 0.6),
       ("a", 2, "test/same_sentence_BLEU_ratio_95", 12.0), ("m", 0, "test/pearson_corr", 0.8), ("m", 0, "test/pearson_pvalue", 0.0001), ("m", 0, "other", 1.0)]


def test_runs_and_report(spark):
    log = spark.createDataFrame(LOG, "run_id string, step bigint, key string, value double")
    values = evaluate.run_values(log, spark.createDataFrame(RUNS, "run_id string, state string, augmented boolean, epochs int, variant string"))
    rows = {r["row_name"]: r for r in reports.with_text(reports.cells(values, reports.CORRELATION)).collect()}
    assert rows["BLEU"]["mean"] == pytest.approx(0.6) and rows["BLEU"]["stdev"] == pytest.approx(0.141421356) and rows["BLEU"]["text"] == "0.6±0.14"
    assert rows["SARI"]["stdev"] is None and rows["SARI"]["text"] == "0.6"
    assert rows[reports.MODEL]["is_best"] and rows[reports.MODEL]["is_significant"] and not rows["BLEU"]["is_best"]
    assert [rows[k]["row_idx"] for k in ("BLEU", "SARI", reports.MODEL)] == [1, 2, 4]
    text = sinks.latex(reports.with_text(reports.cells(values, reports.CORRELATION)), "Title of 100%", ["pearson_corr"])
    assert r"\textbf{\textit{0.8}}" in text and "100\\%" in text and text.count(r"\midrule") == 2


def test_ties_are_all_best(spark):
    values = spark.createDataFrame([("a", "plain_500_fixed", "same_sentence", m, "ratio_95", 5.0) for m in ("X", "Y")], "run_id string, cohort string, split string, metric string, stat string, value double")
    assert [r["is_best"] for r in reports.cells(values, reports.SAME).collect()] == [True, True]


def test_lookup_of_a_missing_key_fails(spark):
    log = spark.createDataFrame(LOG, "run_id string, step bigint, key string, value double")
    s = runs.summaries(log).where("run_id = 'a'")
    assert s.select(runs.lookup(F.col("summary"), "test/BLEU_pearson_corr")).first()[0] == 0.5
    with pytest.raises(Exception, match="no such key"):
        s.select(runs.lookup(F.col("summary"), "none")).collect()


def test_best_checkpoint(spark):
    df = spark.createDataFrame([("a", 1, 0.5, "x"), ("a", 2, 0.5, "y"), ("a", 3, float("nan"), "z"), ("b", 1, 2.0, "w")], "run_id string, step int, eval_loss double, checkpoint string")
    assert {r[0]: r[1] for r in runs.best_checkpoint(df).collect()} == {"a": "x", "b": "w"}


def test_coverage(spark):
    df = spark.createDataFrame([("The quick brown fox jumps. A dog! ...",), ("",)], "t string")
    m = coverage.mask(F.col("t"), lambda w: F.array(F.length(w), F.lit(7)), ["the", "a", "fox"])
    got = df.select(m.alias("m")).select("m", coverage.effective_ratio(F.col("m")).alias("r"), coverage.model_input(F.array(F.lit(5)), F.col("m"), 2).alias("x")).collect()
    first, second = got[0]["m"]
    assert first["masked_words"] == ["quick"] and first["masked"] == [3, 7, 0, 0, 5, 7, 3, 7, 5, 7] and first["is_masked"] == [0, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert second["masked_words"] == ["dog"] and got[0]["r"] == pytest.approx((1 / 5 + 1 / 2) / 2)
    assert got[0]["x"]["ids"][:4] == [5, 2, 3, 7] and got[0]["x"]["labels"][:3] == [-1, -1, 3] and len(got[0]["x"]["flags"]) == len(got[0]["x"]["ids"])
    assert got[1]["m"] == [] and got[1]["r"] is None and got[1]["x"]["ids"] == [5, 2]
    soft = spark.createDataFrame([([1.0, 0.5, 0.2], [1.0, 0.0, 1.0])], "p array<double>, f array<double>").select(coverage.soft_score(F.col("p"), F.col("f"))).first()[0]
    assert soft == pytest.approx(100 * 1.2 / 2.1)


def test_pairs_round_trip_and_checks(spark, tmp_path):
    rows = [(1, "meaning", "train", "a", "b", 1.0), (2, "meaning_with_data_augmentation", "train", "a", "b", 1.0), (3, "meaning_holdout_identical", "test", "a", "a", 100.0)]
    path = str(tmp_path / "pairs")
    spark.createDataFrame(rows, PAIRS).write.parquet(path)
    assert [r[0] for r in tables.training_pairs(spark, path, False).collect()] == [1]
    assert [r[0] for r in tables.training_pairs(spark, path, True).collect()] == [2]
    assert tables.identical_holdout(spark, path).count() == 1 and tables.unrelated_holdout(spark, path).count() == 0
    with pytest.raises(ValueError):
        tables.read_pairs(spark, path, "other")
    spark.createDataFrame([(1,)], "run_id int").write.parquet(str(tmp_path / "runs"))
    with pytest.raises(ValueError, match="columns missing"):
        tables.read_runs(spark, str(tmp_path / "runs"))


def test_log_is_appended_and_streamed(spark, tmp_path):
    path = str(tmp_path / "log")
    long = spark.createDataFrame([("test", "BLEU", "mean", 1.0), ("same_sentence", "BLEU", "ratio_95", 2.0)], "split string, metric string, stat string, value double")
    sinks.append_metrics(sinks.as_events(long, "r", 1), path)
    sinks.append_metrics(sinks.as_events(long.withColumn("value", F.col("value") + 10), "r", 2), path)
    assert tables.read_metric_log(spark, path).count() == 4
    query = run_log.last_value_stream(run_log.read_log(spark, path), "last_values", str(tmp_path / "state"))
    query.awaitTermination(60)
    assert {r["key"]: r["value"] for r in spark.table("last_values").collect()} == {"test/BLEU_mean": 11.0, "test/same_sentence_BLEU_ratio_95": 12.0}


def test_run_table_artifacts_and_pointers(spark, tmp_path):
    sinks.append_run(spark, str(tmp_path / "runs"), "a", "finished", True, 500, "holdout fixed")
    assert runs.route(tables.read_runs(spark, str(tmp_path / "runs"))).first()["cohort"] == "augmented_500_fixed"
    sinks.append_artifact(spark, str(tmp_path / "art"), "a", 1, "best_checkpoint", "x/y")
    assert spark.read.parquet(str(tmp_path / "art")).first()["value"] == "x/y"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.dvc").write_text("outs:\n- md5: abc.dir\n  size: 12\n  nfiles: 3\n  path: V\n")
    r = tables.read_pointers(spark, str(tmp_path / "p")).first()
    assert (r["md5"], r["size"], r["nfiles"]) == ("abc.dir", 12, 3)


def test_regression_learns_a_rule(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for i in range(40):
        k = i % 7 + 1
        rows.append((i, "test", " ".join(words), " ".join(words[:k]), 10.0 * k))
    p = spark.createDataFrame(rows, "pair_id bigint, split string, original string, simplification string, label double")
    out = {r["stat"]: r["value"] for r in train.evaluate(train.predict(train.fit(p), p)).where("split = 'test'").collect()}
    assert out["pearson_corr"] > 0.95


def test_training_scores_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(o, s):
        made.add(1)
        return float(len(s)) if s else None

    metrics.use_model("counted", counted)
    try:
        rows = [(i, "test", "a b c", "a " * (i % 5 + 1), 10.0 * (i % 5)) for i in range(20)] + [(90, "same_sentence", "a b", "a b", 100.0)]
        p = spark.createDataFrame(rows, "pair_id bigint, split string, original string, simplification string, label double")
        model = train.fit(p.where("split = 'test'"), ["counted"])
        assert made.value == 20
        got = {(r["split"], r["stat"]): r["value"] for r in train.evaluate(train.predict(model, p, ["counted"])).collect()}
        assert made.value == 41
        predicted = train.predict(model, p, ["counted"])
        for kind in ("test", "same_sentence", "irrelevant_sentence"):
            row = summary.predictions(predicted.where(F.col("split") == kind), kind).first().asDict()
            assert {k: v for (s, k), v in got.items() if s == kind} == pytest.approx(row, nan_ok=True)
    finally:
        metrics._MODELS.pop("counted")


def test_relative_probability(spark):
    df = spark.createDataFrame([([[0.0, 1.0, 3.0], [2.0, 2.0, 1.0]], [1, -1])], "logits array<array<double>>, labels array<int>")
    assert df.select(coverage.relative_probability(F.col("logits"), F.col("labels"))).first()[0] == pytest.approx([2.718281828**-2, 0.0])


def test_sweep_over_seeds(spark, table):
    many = table.where("pair_id < 2").crossJoin(spark.range(20)).withColumn("pair_id", F.col("pair_id") * 100 + F.col("id")).drop("id")
    got = train.sweep(many, pairs.identical(many, "pair_id", "original"), [42, 43])
    assert {r["run_id"] for r in got.collect()} == {"seed-42", "seed-43"} and got.where("split = 'same_sentence' and stat = 'rmse'").count() == 2


def test_command_line(spark, tmp_path):
    from sensegauge import __main__ as cli

    rows = [(i, "meaning", "test", "the cat sat on the mat", t, 10.0 * i) for i, t in enumerate(("the cat", "a dog", "the cat sat on", "mat"))]
    rows += [(10, "meaning_holdout_identical", "test", "a b c", "a b c", 100.0), (11, "meaning_holdout_unrelated", "test", "a b c", "x y z", 0.0)]
    paths = [str(tmp_path / x) for x in ("pairs", "log", "runs", "out")]
    spark.createDataFrame(rows, PAIRS).write.parquet(paths[0])
    for seed in ("1", "2"):
        cli.run(spark, cli.parser().parse_args(["evaluate", *paths[:3], "--run", f"r{seed}", "--seed", seed, "--data-augmentation", "no"]))
    cli.run(spark, cli.parser().parse_args(["report", *paths[1:], "--count-equals"]))
    text = "\n".join(r[0] for r in spark.read.text(paths[3] + "/identical").collect())
    assert "ROUGE-1 & " in text and "ratio\\_equals" in text
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["evaluate", *paths[:3], "--run", "x", "--data-augmentation", "maybe"])

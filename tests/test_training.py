"""Encoding, reports and parallel fits of the training table on hand-made frames."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threadpulse.operators import training


@pytest.fixture(scope="module")
def frames(spark):
    schema = "id int, n double, f int, l string, y int"
    train = spark.createDataFrame([(1, 1.0, 1, "A ", 1), (2, None, 0, None, 0), (3, 5.0, None, "b", 1), (4, 3.0, 0, "a", 0)], schema)
    test = spark.createDataFrame([(5, 100.0, 1, "new", 1), (6, -7.0, 0, "a", 0)], schema)
    return train, test


FIELDS = {"numbers": ["n"], "flags": ["f"], "labels": ["l"]}


def test_encoder_keeps_unseen_values_and_ranges(frames):
    train, test = training.encoded(*frames, **FIELDS)
    get = lambda df: {r.id: (r.n, r.v) for r in df.select("id", "n", vector_to_array("features").alias("v")).collect()}
    a, b = get(train), get(test)
    size = len(a[1][1])
    assert size == 2 + 4  # a, b, __none__ and one place for what was not seen
    assert a[1][1][:2] == [1.0, 1.0] and a[2][1][:2] == [0.0, 0.0] and a[3][1][:2] == [5.0, 0.0]
    assert a[1][1][2:] == a[4][1][2:] != a[2][1][2:]  # trimmed, in lower case
    assert b[5] == (100.0, [5.0, 1.0, 0.0, 0.0, 0.0, 1.0]) and b[6][1][0] == 1.0


def test_class_report(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1), (0, 0.2), (None, 0.9)], "y int, score double")
    m = training.class_report(rows, "y")
    assert (m["n"], m["accuracy"], m["precision"], m["recall"]) == (5, 0.6, 0.5, 0.5)
    assert m["balanced_accuracy"] == pytest.approx((0.5 + 2 / 3) / 2) and m["f1"] == 0.5 and m["auc"] == pytest.approx(5 / 6)


def test_parallel_keeps_order():
    assert training.in_parallel([lambda i=i: i * i for i in range(20)]) == [i * i for i in range(20)]


def test_settings_and_tasks(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("x"), F.rand(2).alias("z"), "id")
    a, b = df.where("id < 300"), df.where("id >= 300")
    got = training.settings_report(a, b, "y", ["x", "z"], [("tree", {"maxDepth": 1}), ("logistic", {"regParam": 0.0})]).collect()
    assert [r.place for r in got] == [1, 2] and {r.family for r in got} == {"tree", "logistic"} and all(r.n == 100 and r.auc > 0.9 for r in got)
    tasks = training.task_report({"t": (a, b, "y", ["x"]), "none": (a, b.where("id < 0"), "y", ["x"])}, ("tree",)).collect()
    assert [(r.task, r.n) for r in tasks] == [("t", 100), ("none", 0)]


def test_growth_report(spark):
    base = spark.range(900).select("id", (F.col("id") % 30).cast("double").alias("upvote_velocity"), F.lit(1.0).alias("hours_since_previous"), F.when(F.col("id") % 3 == 0, "over_24h").otherwise("under_30m").alias("age_bucket"))
    df = base.withColumn("next_upvote_delta", F.expm1(F.col("upvote_velocity") / 10)).withColumn("next_comment_delta", F.lit(None).cast("double"))
    for c in training.NUMBERS + training.FLAGS + training.LABELS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c in training.LABELS else "double"))
    got = {(r.target, r.model): r for r in training.growth_report(df.where("id < 600"), df.where("id >= 600")).collect()}
    assert {k[1] for k in got} == {"naive", "ridge", "ridge by bucket", "forest"} and {k[0] for k in got} == {"next_upvote_delta"}
    assert got["next_upvote_delta", "ridge"].r2 > 0.9 and got["next_upvote_delta", "forest"].r2 > 0.3 and got["next_upvote_delta", "naive"].n == 300


def test_forest_reads_words_once(spark, monkeypatch):
    """The frame of the forest is written before the fit, so texts are not parsed again for each of its passes."""
    from oracle import DATA
    from threadpulse.plans import registry

    seen, plain = [], registry.models.forest_scores
    monkeypatch.setattr(registry.models, "forest_scores", lambda frame, *a: seen.append(frame._jdf.queryExecution().optimizedPlan().toString()) or plain(frame, *a))
    assert registry.queries()["forest_emergence"](spark, DATA).count() > 0
    assert "Generate" not in seen[0] and "Aggregate" not in seen[0]


def test_settings_make_their_own_table_only(spark, monkeypatch):
    """The settings are tried on one task, so the tables of the nine others are not made."""
    from oracle import DATA
    from threadpulse.plans import registry, training as plans  # noqa: F401

    def never(*_):
        raise AssertionError("another task's table was made")

    for name in ("grid", "community_days", "peak_profiles"):
        monkeypatch.setattr(plans if name == "grid" else plans.labels, name, never)
    monkeypatch.setattr(plans.training, "grid", lambda: [("tree", {"maxDepth": 2})])
    assert [r.family for r in plans.settings(spark, DATA).collect()] == ["tree"]


def test_cluster_words_reads_texts_once(spark, monkeypatch):
    from oracle import DATA
    from threadpulse.plans import registry, learn

    seen, plain = [], learn.learners.cluster_words
    monkeypatch.setattr(learn.learners, "cluster_words", lambda frame, *a: seen.append(frame._jdf.queryExecution().optimizedPlan().toString()) or plain(frame, *a))
    assert registry.queries()["cluster_words"](spark, DATA).count() > 0
    assert "regexp" not in seen[0]


def test_class_metrics_are_those_of_all_rows(spark):
    """Equal rows scored, and learned from, once with their number give what every row for itself gives."""
    from threadpulse.operators import learners

    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"), ((F.col("id") * 5 % 11 + F.col("id") % 7) > 8).cast("int").alias("y"))
    a, b = df.where("id < 400"), df.where("id >= 400")
    tried = [("tree", {"maxDepth": 3}), ("tree", {"maxDepth": 3, "minInstancesPerNode": 30}), ("boosting", {}), ("forest", {"numTrees": 5}), ("logistic", {"regParam": 0.1})]
    for (family, options), m in zip(tried, learners.class_metrics(a, b, "y", ["x", "z"], tried)):
        each = learners.score_metrics(learners.class_scores(a, b, "y", ["x", "z"], family, **options), "y")
        assert m["n"] == each["n"] == 200 and m["accuracy"] == pytest.approx(each["accuracy"]) and m["auc"] == pytest.approx(each["auc"]), family
    one, none = a.where("y = 1"), a.where("id < 0")
    assert learners.class_metrics(one, b, "y", ["x"], [("tree", {})])[0]["auc"] == pytest.approx(0.5)
    assert learners.class_metrics(none, b, "y", ["x"], [("tree", {})]) == [{"n": 200, "accuracy": None, "auc": None}]


def test_repeats_are_counted_on_keys_alone(spark, monkeypatch):
    """prior_repeats reads its rows several times, so it gets written keys and not the wide rows, which would be made again for each time."""
    from oracle import DATA
    from threadpulse.plans import registry, training as plans  # noqa: F401

    class Seen(Exception):
        pass

    def stop(rows, *_):
        raise Seen(len(rows.columns), rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(training, "prior_repeats", stop)
    with pytest.raises(Seen) as seen:
        plans.table(spark, DATA)
    assert seen.value.args[0] == 4 and "Window" not in seen.value.args[1]

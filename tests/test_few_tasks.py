"""Training begins from stored samples in few partitions, and evaluation is one pass."""

import datetime

import pytest

from strandline.operators import evaluation as E
from strandline.operators import models as M
from strandline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "fit"), [("ml13_gbt_lr", "hybrid"), ("ml13_gbt_lr_sgd", "hybrid"), ("ml9_boosted_trees", "boosted_trees"), ("ml8_deep_forest_on_base_and_history", "random_forest")])
def test_no_shuffle_beneath_training(spark, monkeypatch, name, fit):
    def seen(train, *_, **__):
        raise Seen(train)

    monkeypatch.setattr(M, fit, seen)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, SF)
    train = found.value.args[0]
    assert train.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert "Shuffle" not in train._jdf.queryExecution().toRdd().toDebugString()


def test_no_plan_beneath_neighbours(spark, monkeypatch):
    """Else what is persisted on each step stands several times in every plan of the next, and descriptions fill the driver."""

    def seen(_, train, **__):
        raise Seen(train)

    monkeypatch.setattr(M.Descent, "model", seen)
    with pytest.raises(Seen) as found:
        QUERIES["ml18_time_match_lr"](spark, SF)
    train = found.value.args[0]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "neighbours" in train.columns and len(plan.splitlines()) < 100 and "Window" not in plan and "SortMergeJoin" not in plan


def test_deep_forests_keep_node_ids(monkeypatch):
    """Else every level sends all trees to all tasks, which walk each row down from the roots."""

    def made(**options):
        raise Seen(options["cacheNodeIds"])

    monkeypatch.setattr(M, "RandomForestClassifier", made)
    for depth, kept in ((20, True), (10, False)):
        with pytest.raises(Seen) as found:
            M.random_forest(None, depth=depth)
        assert found.value.args[0] is kept


def test_few_tasks_keeps_all_rows_and_grows(spark, monkeypatch):
    rows = spark.range(1000, numPartitions=40)
    kept = M.few_tasks(rows)
    assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and sorted(r.id for r in kept.collect()) == list(range(1000))
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    assert M.few_tasks(rows).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert M.few_tasks(rows.limit(0)).count() == 0


def test_evaluate_is_one_pass(spark):
    day = datetime.date(2024, 1, 25)
    rows = [(day, 1, 1), (day, 1, 0), (day, 0, 0), (day, 0, 1), (day, 0, 0), (None, 1, 1)]
    found = E.evaluate(spark.createDataFrame(rows, "date date, label int, prediction int"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert [(r.date, r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1) for r in got] == [(day, 1, 1, 2, 1, 0.5, 0.5, 0.5)]
    assert got[0].auc == pytest.approx((1 / 2 + 2 / 3) / 2)

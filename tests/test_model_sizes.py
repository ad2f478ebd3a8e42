"""The registered models are as large as the reference's."""

import pytest

from strandline.operators import models as M
from strandline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "size"), [("ml9_boosted_trees", (50, 6)), ("ml12_rf_lr", (50, 10)), ("ml13_gbt_lr", (50, 8)), ("ml20_rf_time_lr", (50, 10)), ("ml21_recall_controlled_lr", (50, 10)), ("ml22_full_data_hybrid", (50, 10))])
def test_trees_and_depth(spark, monkeypatch, name, size):
    def seen(kind, number):
        def made(**options):
            raise Seen(options[number], options["maxDepth"])

        monkeypatch.setattr(M, kind, made)

    seen("GBTClassifier", "maxIter")
    seen("RandomForestClassifier", "numTrees")
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, SF)
    assert found.value.args == size


def test_threshold_of_boosted_leaves(spark, monkeypatch):
    found = []
    monkeypatch.setattr(M, "hybrid", lambda train, fit, **_: fit(train))
    monkeypatch.setattr(M, "LogisticRegression", lambda **options: found.append(options) or (_ for _ in ()).throw(Seen()))
    with pytest.raises(Seen):
        QUERIES["ml13_gbt_lr"](spark, SF)
    assert found[0]["threshold"] == 0.01


def test_factor_owners_have_fifty_factors(spark):
    assert {r["rank"] for r in QUERIES["jn22_factor_owners"](spark, SF).collect()} <= {50}

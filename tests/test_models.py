"""Registered model queries use the surveyed fit sizes."""

import pytest

import __spark_entry__ as entry
from tapeline.operators import learned


@pytest.mark.parametrize("name,model", [("m12_next_pattern", "GBTClassifier"), ("m13_boosted_folds", "GBTRegressor")])
def test_boosting_rounds(spark, root, monkeypatch, name, model):
    class Seen(Exception):
        pass

    def built(**params):
        raise Seen(params["maxIter"])

    monkeypatch.setattr(learned, model, built)
    with pytest.raises(Seen) as seen:
        entry.queries()[name](spark, root)
    assert seen.value.args == (100,)


def test_ratio_of_zero(spark):
    """Ratios with a zero below follow IEEE, as in the statement of p21, and do not end the job."""
    from tapeline.operators.projections import F, ratio

    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (None, 0.0)], "a double, b double")
    assert [str(r.q) for r in rows.select(ratio(F.col("a"), F.col("b")).alias("q")).collect()] == ["0.5", "inf", "-inf", "nan", "None"]

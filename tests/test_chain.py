"""Chains of table steps, and models per group."""

import numpy as np
import pytest

from tidemark.operators.chain import Chain, Step
from tidemark.plans import scoring as P

ROWS = [("a", 1, 2.0, "x"), ("a", 2, -4.0, "y"), ("b", 1, 0.0, "x"), ("b", 2, None, None)]
SCHEMA = "code string, day int, close double, kind string"
STEPS = [
    Step("before", "prior", ("close",), ("opening",), {"by": "code", "order": "day"}),
    Step("scaled", "scale", ("close", "opening"), ("c", "o"), {"by": "code", "of": "close"}),
    Step("whole", "fill", ("c", "o"), ("c", "o"), {"value": 0.0}),
    Step("kinds", "classes", ("kind",), ("kind_no",), {}),
    Step("move", "formula", ("c", "o"), ("move",), {"sql": "c - o"}),
]


def values(df):
    return sorted((r["code"], r["day"], r["c"], r["o"], r["kind_no"], r["move"]) for r in df.collect())


def test_fitted_chain_survives_storing(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    fitted = Chain(STEPS).fit(table)
    want = [("a", 1, 0.5, 0.0, 0, 0.5), ("a", 2, -1.0, 0.5, 1, -1.5), ("b", 1, 0.0, 0.0, 0, 0.0), ("b", 2, 0.0, 0.0, None, 0.0)]
    assert values(fitted.apply(table)) == want
    fitted.save(spark, str(tmp_path / "chain"))
    again = Chain.load(spark, str(tmp_path / "chain"))
    assert again.steps == tuple(Step(s.name, s.kind, s.inputs, s.outputs, dict(s.params)) for s in STEPS)
    assert values(again.apply(table)) == want
    # what was learnt stays when the table changes
    other = spark.createDataFrame([("a", 1, 8.0, "z"), ("c", 1, 8.0, "y")], SCHEMA)
    assert values(again.apply(other)) == [("a", 1, 2.0, 0.0, None, 2.0), ("c", 1, 0.0, 0.0, 1, 0.0)]


def test_wrong_order_and_unknown_steps_are_refused(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="scaled reads"):
        Chain([STEPS[1], STEPS[0]]).fit(table)
    with pytest.raises(ValueError, match="before reads"):
        Chain(STEPS).check(["code", "close"])
    with pytest.raises(ValueError, match="one name"):
        Chain([STEPS[0], STEPS[0]])
    with pytest.raises(ValueError, match="known kind"):
        Chain([Step("x", "guess", (), ())])
    with pytest.raises(ValueError, match="not been fitted"):
        Chain(STEPS).apply(table)


def test_model_per_group(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, weights in (("p", (2.0, -1.0, 5.0)), ("q", (0.0, 3.0, -2.0))):
        for a, b in rng.normal(size=(200, 2)):
            rows.append((name, float(a), float(b), float(weights[0] * a + weights[1] * b + weights[2] + rng.normal() * 0.1)))
    rows += [("p", None, 1.0, 1.0), ("one", 1.0, 1.0, 7.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "kind string, a double, b double, y double")
    models = {r["kind"]: r for r in P.fit_by_group(df, "kind", ["a", "b"], "y").collect()}
    assert set(models) == {"p", "q", "one"}
    for name in "pq":
        own = np.array([r[1:] for r in rows if r[0] == name and r[1] is not None])
        want = np.linalg.lstsq(np.c_[own[:, :2], np.ones(len(own))], own[:, 2], rcond=None)[0]
        assert np.allclose([*models[name]["weights"], models[name]["intercept"]], want)
    scored = P.score_by_group(P.fit_by_group(df, "kind", ["a", "b"], "y"), df, "kind", ["a", "b"], ["a", "b"])
    assert scored.count() == 401
    assert [r["predicted"] for r in scored.where("kind = 'one'").collect()] == [7.0]

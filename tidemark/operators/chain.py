"""Ordered chains of table steps with declared columns, fitted on one table, stored, and applied to others.

A step names its kind, the columns it reads, the columns it makes, and its parameters.  A chain is checked before anything runs: a step whose
inputs no earlier step and no column of the table provides is refused.  What a step learns from the table it is fitted on, a small
table, is stored beside the chain.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """``kind`` is one of ``KINDS``; ``params`` hold plain values only."""

    name: str
    kind: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    params: Mapping[str, object] = field(default_factory=dict)


def _prior(table: DataFrame, step: Step, learnt: DataFrame | None) -> DataFrame:
    """The value of the row before, per ``by`` in the order of ``order``."""
    w = Window.partitionBy(step.params["by"]).orderBy(step.params["order"])
    return table.withColumns({o: F.lag(i).over(w) for i, o in zip(step.inputs, step.outputs)})


def _fill(table: DataFrame, step: Step, learnt: DataFrame | None) -> DataFrame:
    """Nulls replaced by ``value``."""
    return table.withColumns({o: F.coalesce(F.col(i), F.lit(step.params["value"])) for i, o in zip(step.inputs, step.outputs)})


def _fit_scale(table: DataFrame, step: Step) -> DataFrame:
    """Largest absolute value of the first input, or of the column ``of``, per ``by``; 1 where it is 0."""
    top = F.max(F.abs(F.col(step.params.get("of", step.inputs[0])).cast("double")))
    return table.groupBy(step.params["by"]).agg(F.when(top == 0, 1.0).otherwise(top).alias("_scale"))


def _scale(table: DataFrame, step: Step, learnt: DataFrame | None) -> DataFrame:
    """Inputs divided by the scale of their group; a group that was not there when the chain was fitted has none."""
    rows = table.join(learnt, step.params["by"], "left")
    return rows.withColumns({o: F.col(i).cast("double") / F.col("_scale") for i, o in zip(step.inputs, step.outputs)}).drop("_scale")


def _fit_classes(table: DataFrame, step: Step) -> DataFrame:
    """Values of the input in ascending order, numbered from 0."""
    values = table.groupBy(step.inputs[0]).agg(F.count(F.lit(1)).alias("_n")).where(F.col(step.inputs[0]).isNotNull())
    listed = values.agg(F.array_sort(F.collect_list(step.inputs[0])).alias("_values"))
    return listed.select(F.posexplode("_values").alias("_class", step.inputs[0]))


def _classes(table: DataFrame, step: Step, learnt: DataFrame | None) -> DataFrame:
    """The number of the input's value; null for one that was not there."""
    return table.join(learnt.withColumnRenamed("_class", step.outputs[0]), step.inputs[0], "left")


def _formula(table: DataFrame, step: Step, learnt: DataFrame | None) -> DataFrame:
    """A SQL expression over the inputs."""
    return table.withColumn(step.outputs[0], F.expr(str(step.params["sql"])))


#: kind: (learns, applies)
KINDS = {
    "prior": (None, _prior), "fill": (None, _fill), "scale": (_fit_scale, _scale), "classes": (_fit_classes, _classes), "formula": (None, _formula),
}


class Chain:
    """Steps in the order in which they run."""

    def __init__(self, steps: Sequence[Step], learnt: Mapping[str, DataFrame] | None = None):
        names = [s.name for s in steps]
        if len(set(names)) < len(names):
            raise ValueError(f"steps of one name: {sorted(n for n in set(names) if names.count(n) > 1)}")
        unknown = [s.name for s in steps if s.kind not in KINDS]
        if unknown:
            raise ValueError(f"steps of no known kind: {unknown}")
        self.steps, self.learnt = tuple(steps), dict(learnt or {})

    def check(self, columns: Sequence[str]) -> list[str]:
        """Columns after the last step; refuses a step that reads what is not there yet."""
        known = list(columns)
        for step in self.steps:
            reads = [*step.inputs, *[v for k, v in step.params.items() if k in ("by", "order", "of")]]
            missing = [c for c in reads if c not in known]
            if missing:
                raise ValueError(f"step {step.name} reads {missing}, which no step before it makes")
            known += [c for c in step.outputs if c not in known]
        return known

    def fit(self, table: DataFrame) -> Chain:
        """Each step learns from the table as the steps before it leave it."""
        self.check(table.columns)
        learnt = {}
        for step in self.steps:
            fit, apply = KINDS[step.kind]
            if fit is not None:
                learnt[step.name] = fit(table, step)
            table = apply(table, step, learnt.get(step.name))
        return Chain(self.steps, learnt)

    def apply(self, table: DataFrame) -> DataFrame:
        columns = self.check(table.columns)
        for step in self.steps:
            fit, apply = KINDS[step.kind]
            if fit is not None and step.name not in self.learnt:
                raise ValueError(f"step {step.name} has not been fitted")
            table = apply(table, step, self.learnt.get(step.name))
        return table.select(*columns)

    def save(self, spark: SparkSession, path: str) -> None:
        """Tables of the fitted steps first, then the chain itself, so a chain that can be read is whole."""
        for name, table in self.learnt.items():
            table.write.mode("overwrite").parquet(f"{path}/learnt/{name}")
        steps = [{"name": s.name, "kind": s.kind, "inputs": s.inputs, "outputs": s.outputs, "params": dict(s.params)} for s in self.steps]
        spark.createDataFrame([(json.dumps(steps, ensure_ascii=False),)], "steps string").write.mode("overwrite").parquet(f"{path}/steps")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Chain:
        told = json.loads(spark.read.parquet(f"{path}/steps").first()["steps"])
        steps = [Step(s["name"], s["kind"], tuple(s["inputs"]), tuple(s["outputs"]), s["params"]) for s in told]
        return Chain(steps, {s.name: spark.read.parquet(f"{path}/learnt/{s.name}") for s in steps if KINDS[s.kind][0] is not None})

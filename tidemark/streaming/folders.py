"""Folders that micro-batches write, one each, merged as they grow in number.

A batch owns ``batch=N`` and overwrites it when it runs again.  Of every ``EVERY`` folders of one size a wider one, ``batch=A-B``, is written, of every
``EVERY`` wider ones a still wider one, so a row is copied once per size and the number of folders grows with the logarithm of the batches.
A wider folder counts from the moment its success marker is there, and whatever lies inside it no longer does; narrower folders are deleted after
that.  A crash between any two steps therefore leaves every row readable exactly once.  The newest batch is never merged: it may run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

EVERY = 8


def _names(spark: SparkSession, path: str) -> list[str]:
    """Finished folders below a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(conf)
    if not system.exists(top):
        return []
    inner = [s.getPath() for s in system.listStatus(top) if s.isDirectory()]
    return [p.getName() for p in inner if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes one folder of a store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def span(name: str) -> tuple[int, int] | None:
    """First and last batch of a folder; the rows a store starts from come before batch 0."""
    kind, _, text = name.partition("=")
    if kind != "batch":
        return None
    if text == "seed":
        return -1, -1
    first, _, last = text.partition("-")
    return (int(first), int(last or first)) if first.isdigit() and (last or first).isdigit() else None


def covering(names: list[str]) -> list[str]:
    """The widest folders that hold every batch once."""
    spans = sorted((s[0], -s[1], name) for name in names if (s := span(name)) is not None)
    chosen, reached = [], -2
    for first, last, name in spans:
        if first > reached:
            chosen.append(name)
            reached = -last
    return chosen


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store, each batch once."""
    names = covering(_names(spark, path))
    if not names:
        raise FileNotFoundError(f"no finished batch in {path}")
    return spark.read.parquet(*[f"{path}/{n}" for n in names])


def merge(spark: SparkSession, path: str, final: int, every: int = EVERY, reduce: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Merges the folders of batches up to ``final``, which run no more, where ``every`` of one size are complete."""
    size = every
    while (final + 1) % size == 0 and final + 1 >= size:
        first = final + 1 - size
        names = _names(spark, path)
        wide = f"batch={first}-{final}"
        if wide not in names:
            inner = [n for n in covering(names) if first <= span(n)[0] and span(n)[1] <= final]
            if inner:
                rows = spark.read.parquet(*[f"{path}/{n}" for n in inner])
                (reduce(rows) if reduce else rows).write.mode("overwrite").parquet(f"{path}/{wide}")
        size *= every
    names = _names(spark, path)
    kept = set(covering(names))
    for name in names:
        if name not in kept and span(name) is not None and span(name)[1] <= final:
            delete(spark, f"{path}/{name}")


def drop_before(spark: SparkSession, path: str, batch: int) -> None:
    """Deletes folders of batches before ``batch``, for stores whose every folder replaces the one before."""
    for name in _names(spark, path):
        if span(name) is not None and span(name)[1] < batch:
            delete(spark, f"{path}/{name}")

"""Bounded samples of labelled texts for fitting classifiers, chosen row by row."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a label's candidates that are ranked on their own first.
PARTS = 64
#: Values of the hash that thresholds are compared with.
RANGE = 1 << 30


def threshold(wanted: int, rows: int) -> int:
    """Of how many values in RANGE a hash must be one of the lowest, so that `wanted` of so many rows (or a few more) pass."""
    return RANGE if rows <= wanted else min(RANGE, math.ceil(RANGE * (wanted + 6 * math.sqrt(wanted) + 20) / rows))


def place(*columns: Column | str) -> Column:
    """The hash that thresholds are compared with."""
    return F.pmod(F.xxhash64(*columns), F.lit(RANGE))


def below(label: Column, limits: dict, at: Column) -> Column:
    """Whether a row passes its label's threshold; limits has a row a label and is a literal of the plan."""
    if not limits:
        return F.lit(False)
    pairs = [x for k, v in sorted(limits.items(), key=lambda i: str(i[0])) for x in (F.lit(k), F.lit(v))]
    return F.coalesce(at < F.create_map(*pairs)[label], F.lit(False))


def bounded_sample(rows: DataFrame, per_label: int, per_label_chars: int) -> DataFrame:
    """(label, n from 1, text): of rows (label, text, h) at most per_label texts of a label in the order of (h, text), and none
    after per_label_chars characters. Each text comes with the label of its own row. A label's rows are ranked in PARTS
    parts first, so no task sees all rows of a hot label."""
    first = Window.partitionBy("label", F.pmod(F.xxhash64("h", "text"), F.lit(PARTS))).orderBy("h", "text")
    some = rows.select("label", "text", "h").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_label)
    order = Window.partitionBy("label").orderBy("h", "text")
    best = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.withColumn("before", before).filter(F.col("before") < per_label_chars).select("label", "n", "text")


def fit_on(sample: DataFrame, fit: Callable[[dict], object]) -> bytes | None:
    """The pickled result of fit({label: texts in order}) on a bounded sample (label, n, text), made by one task of an
    executor, so that neither texts nor the fit burden the driver; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for label, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(label, []).append((n, text))
        if found:
            model = pickle.dumps(fit({k: [t for _, t in sorted(found.pop(k))] for k in sorted(found)}))
            yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else None

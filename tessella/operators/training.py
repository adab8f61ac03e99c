"""Linear readouts trained by the delta rule, in rounds over rows that stay where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import ship


@dataclass
class Readout:
    w: np.ndarray
    b: float = 0.0
    epochs: int = 0  # that the best weights had seen
    f1: float = -1.0  # of the best weights over the validation rows

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


#: Sums that come before those of the weights: train rows, error, and true, false and missed hits of validation rows.
HEAD = 5


def sums(model: Readout, x: np.ndarray, y: np.ndarray, train: np.ndarray) -> np.ndarray:
    """What a round needs of some rows: the gradient over train rows, and counts over the others."""
    m = model.margin(x)
    err = (1 / (1 + np.exp(-np.clip(m[train], -60, 60)))) - y[train]
    hit, yes = m[~train] > 0, y[~train]
    return np.concatenate([[train.sum(), err.sum(), (hit & yes).sum(), (hit & ~yes).sum(), (~hit & yes).sum()], x[train].T @ err])


def fit(df: DataFrame, by: str, vector: str, label: str, split: str, rate: float = 2.0, l2: float = 1e-5, epochs: int = 40, patience: int = 8) -> dict[object, Readout]:
    """A readout for each value of `by`, of which there are few: the weights of the epoch with the best validation F1.

    An epoch is one job for all of them: tasks sum the gradient of their train
    rows and count over their validation rows (the rows whose split is not
    'train'), and one number for each weight comes back. All rows count; a readout
    stops when none of `patience` epochs was better.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(by).alias("by"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("boolean").alias("y"), (F.col(split) == "train").alias("train")).where("by is not null and x is not null and y is not null and train is not null").persist()
    try:
        size = {r["by"]: r["d"] for r in rows.groupBy("by").agg(F.max(F.size("x")).alias("d")).collect()}
        now = {k: Readout(np.zeros(d)) for k, d in size.items()}
        best = dict(now)
        open_ = set(now)
        for epoch in range(epochs + 1):
            models = {k: now[k] for k in open_}

            def partial(batches: Iterator[pa.RecordBatch], models=models) -> Iterator[pa.RecordBatch]:
                total: dict[object, np.ndarray] = {}
                kind = None
                for b in batches:
                    kind = b.schema.field(0).type
                    keys = np.array(b.column(0).to_pylist(), object)
                    y, train = (np.array(b.column(i).to_pylist(), bool) for i in (2, 3))
                    for k in set(keys.tolist()) & models.keys():
                        at = np.flatnonzero(keys == k)
                        x = np.array(b.column(1).take(pa.array(at)).to_pylist(), float)
                        total[k] = total.get(k, 0) + sums(models[k], x, y[at], train[at])
                for k, t in total.items():
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(t), kind), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(t)], ["by", "place", "v"])

            back = rows.mapInArrow(partial, f"by {dict(rows.dtypes)['by']}, place int, v double").groupBy("by", "place").agg(F.sum("v").alias("v")).collect()
            got = {k: np.zeros(HEAD + size[k]) for k in open_}
            for r in back:
                got[r["by"]][r["place"]] = r["v"]
            for k in sorted(open_, key=str):
                n, err, tp, fp, fn = got[k][:HEAD]
                f1 = float(2 * tp / (2 * tp + fp + fn)) if tp else 0.0
                if f1 > best[k].f1:
                    best[k] = Readout(now[k].w, now[k].b, epoch, f1)
                elif epoch - best[k].epochs >= patience:
                    open_ = open_ - {k}
                n = max(n, 1.0)
                now[k] = Readout(now[k].w - rate * (got[k][HEAD:] / n + l2 * now[k].w), now[k].b - rate * float(err / n))
            if not open_:
                break
        return best
    finally:
        rows.unpersist()


def probe(df: DataFrame, variants: dict[str, Column], label: str, split: str) -> DataFrame:
    """(variant, rows, epochs, f1): a linear probe on each encoding of all rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), v.cast("array<double>").alias("x")) for n, v in variants.items()]))
    rows = df.select(F.col(label).alias("y"), F.col(split).alias("split"), each.alias("e")).select("y", "split", "e.*")
    n = df.count()
    found = fit(rows, "variant", "x", "y", "split")
    return df.sparkSession.createDataFrame([(k, n, r.epochs, r.f1) for k, r in sorted(found.items())], "variant string, rows long, epochs int, f1 double")

"""Encoders that are fitted once, saved, and put on other rows without the rows they were fitted on.

Each estimator's model is a table of one row per value (or a few cut points) with its settings; ``write().save(path)`` keeps both as files, and
``EncoderModel.load(path)`` reads them in any session. The tables never reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.base import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.operators.encode import impact_table, interval_number, label_dictionary, printed, quantile_edges
from paytrail.operators.groups import cell, cell_stats
from paytrail.operators.lookup import attach, lookup_cells
from paytrail.sources.scratch import Pinned, pin


class EncoderModel(Model, MLWritable, MLReadable):
    """``settings``: kind, columns and numbers; ``table``: one row per known value, None for cut points.

    ``transform`` adds the named columns. A value that was not seen in fitting gets code -1, frequency 0, the mean label, or the bin that it lies in or next to.
    """

    def __init__(self, settings: dict, table: Pinned | None = None):
        super().__init__()
        self.settings, self.table = settings, table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = self.settings
        if own["kind"] == "bins":
            for c, b in own["bins"].items():
                dataset = _placed(dataset, c, b["edges"], own["suffix"], b["codes"])
            return dataset
        if own["kind"] == "impact":
            out = attach(dataset, self.table, own["key"])
            return out.withColumn(own["name"], F.coalesce("mapping", F.lit(own["mean"]))).drop("mapping")
        codes = own["kind"] == "codes"
        payload, none = ("code", -1) if codes else ("seen", 0)
        cells = {c: printed(dataset, c) if codes else cell(dataset, c) for c in own["columns"]}
        out = lookup_cells(dataset, cells, self.table, [payload], own["unique"])
        named = {f"{c}{own['suffix']}": F.coalesce(F.col(f"`{payload}_{c}`"), F.lit(none)).cast("long") for c in own["columns"]}
        return out.withColumns(named).drop(*[f"{payload}_{c}" for c in own["columns"]])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: EncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        table = self.model.table
        extra = {"settings": json.dumps(self.model.settings), "rows": table.rows if table else -1, "bytes": table.bytes if table else 0}
        if table:
            table.df.write.parquet(f"{path}/table")
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)


class _Reader(MLReader):
    def load(self, path: str) -> EncoderModel:
        kept = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = Pinned(self.sparkSession.read.parquet(f"{path}/table"), kept["rows"], kept["bytes"], {}) if kept["rows"] >= 0 else None
        return EncoderModel(json.loads(kept["settings"]), table)


class LabelCodes(Estimator):
    """Rank of each printed value among the values of its column, missing ones being a value. ``unique``: columns that tell the rows to be coded apart."""

    def __init__(self, columns: Sequence[str], unique: Sequence[str], suffix: str = "_code"):
        super().__init__()
        self.settings = {"kind": "codes", "columns": [*columns], "unique": [*unique], "suffix": suffix}

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        return EncoderModel(self.settings, pin(label_dictionary(dataset, self.settings["columns"]).df, "codes"))


class Frequencies(Estimator):
    """Number of fitted rows with the same value, nulls counted as a value."""

    def __init__(self, columns: Sequence[str], unique: Sequence[str], suffix: str = "_count"):
        super().__init__()
        self.settings = {"kind": "frequencies", "columns": [*columns], "unique": [*unique], "suffix": suffix}

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        return EncoderModel(self.settings, cell_stats(dataset, self.settings["columns"], {"seen": F.count(F.lit(1))}))


class ImpactCodes(Estimator):
    """Out-of-fold label mean of each key as unlabelled rows get it; keys that were never labelled, and null, get the mean label."""

    def __init__(self, key: str, label: str, outer: str, inner: str, name: str, n_outer: int = 5, n_inner: int = 5):
        super().__init__()
        self.settings, self.folds = {"kind": "impact", "key": key, "name": name}, (label, outer, inner, n_outer, n_inner)

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        label, outer, inner, n_outer, n_inner = self.folds
        table = impact_table(dataset, self.settings["key"], label, outer, inner, n_outer, n_inner).select(self.settings["key"], "mapping")
        mean = dataset.agg(F.avg(F.col(label).cast("double"))).first()[0]
        return EncoderModel(self.settings | {"mean": mean}, pin(table, "impact"))


def _placed(df: DataFrame, col: str, edges: Sequence[float], suffix: str, codes: Sequence[int] | None = None) -> DataFrame:
    """Interval of a value between the first and the last edge; values beyond lie in the outer ones. ``codes``: the number of each interval."""
    name = f"{col}{suffix}"
    if len(edges) < 2:
        return df.withColumn(name, F.when(F.col(col).isNotNull(), F.lit(0)).cast("long"))
    inside = F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col).cast("double"), F.lit(edges[0])), F.lit(edges[-1])))
    out = interval_number(df.withColumn("_inside", inside), "_inside", edges, "_slot_of").drop("_inside")
    slot = F.col("_slot_of") if codes is None else F.get(F.lit([*codes]), F.col("_slot_of"))
    return out.withColumn(name, slot.cast("long")).drop("_slot_of")


class QuantileBins(Estimator):
    """Bins between exact quantiles, numbered densely over the bins that hold a fitted row. At most ``bins + 1`` edges a column."""

    def __init__(self, columns: Sequence[str], bins: int = 256, suffix: str = "_bin"):
        super().__init__()
        self.columns, self.bins, self.suffix = [*columns], bins, suffix

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        found = {}
        for c in self.columns:
            edges = [float(e) for e in quantile_edges(dataset.filter(F.col(c).isNotNull()), c, self.bins)]
            slots = {r[0] for r in _placed(dataset.select(c), c, edges, "_s").select(f"{c}_s").distinct().collect()} - {None}  # at most one row a bin
            filled = [sum(s <= i for s in slots) for i in range(max(len(edges) - 1, 1))]
            found[c] = {"edges": edges, "codes": [max(0, n - 1) for n in filled]}
        return EncoderModel({"kind": "bins", "bins": found, "suffix": self.suffix})


def saved(model: EncoderModel, path: str) -> EncoderModel:
    """The model as read back from ``path``."""
    model.write().save(path)
    return EncoderModel.read().session(SparkSession.active()).load(path)

"""The life cycle shared by all forecasters: split, fit on train, score, save."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import score
from ..operators.ordered import Profile, profile
from ..operators.split import chronological_split
from ..schema import FEATURES, TARGET
from ..session import cut_lineage

KINDS: dict[str, type] = {}


class Forecaster:
    """A fitted model: ``transform`` adds ``prediction``; ``meta`` and ``parts`` are all that is saved."""

    kind = ""

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        KINDS[cls.kind] = cls

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def meta(self) -> dict:
        """Plain numbers and names."""
        return {}

    def parts(self) -> list:
        """Nested Spark ML models and forecasters."""
        return []

    @classmethod
    def restore(cls, meta: dict, parts: list) -> Forecaster:
        raise NotImplementedError


class PipelineForecaster(Forecaster):
    """A Spark ML pipeline whose last stage writes ``prediction``."""

    kind = "pipeline"

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        made = self.model.transform(df)
        return made.select(*df.columns, "prediction")

    def parts(self) -> list:
        return [self.model]

    @classmethod
    def restore(cls, meta, parts):
        return cls(parts[0])


def save_model(spark: SparkSession, model: Forecaster, path: str) -> None:
    """Write a forecaster under ``path``, replacing an older one."""
    parts = model.parts()
    note = {"kind": model.kind, "meta": model.meta(), "parts": ["model" if isinstance(p, Forecaster) else "ml" for p in parts]}
    spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.mode("overwrite").text(f"{path}/note")
    for i, part in enumerate(parts):
        if isinstance(part, Forecaster):
            save_model(spark, part, f"{path}/part{i}")
        else:
            wrapped = part if isinstance(part, PipelineModel) else PipelineModel([part])
            wrapped.write().overwrite().save(f"{path}/part{i}")


def load_model(spark: SparkSession, path: str) -> Forecaster:
    """Read a forecaster written by :func:`save_model`."""
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    parts = [
        load_model(spark, f"{path}/part{i}") if kind == "model" else PipelineModel.load(f"{path}/part{i}")
        for i, kind in enumerate(note["parts"])
    ]
    return KINDS[note["kind"]].restore(note["meta"], parts)


@dataclass
class Evaluation:
    """A fitted model with its validation and test predictions and their scores."""

    model: Forecaster
    predictions: DataFrame
    scores: DataFrame


def evaluate(
    model: Forecaster,
    split: DataFrame,
    time_col: str,
    name: str,
    freq: str,
    target: str = TARGET,
    prof: Profile | None = None,
) -> Evaluation:
    """Predict the validation and test rows and score both."""
    held_out = split.filter(F.col("split") != "train")
    predictions = model.transform(held_out).select(
        F.col(time_col),
        F.col(target).cast("double").alias("actual"),
        F.col("prediction").alias("predicted"),
        "split",
        F.lit(name).alias("model"),
        F.lit(freq).alias("freq"),
    )
    scores = score(predictions, time_col, by=["model", "freq", "split"], prof=prof)
    return Evaluation(model, predictions, scores)


def fit_and_evaluate(
    df: DataFrame,
    fit: Callable[[DataFrame], Forecaster],
    time_col: str,
    name: str,
    freq: str,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
) -> Evaluation:
    """Chronological 60/20/20 split, ``fit`` on the train rows, scores of the others.

    The split is stored in the shared folder, because the learner iterates over it.
    """
    narrow = df.select(time_col, target, *features)
    prof = profile(narrow, time_col)
    split = cut_lineage(chronological_split(narrow, time_col, prof=prof))
    model = fit(split.filter(F.col("split") == "train"))
    return evaluate(model, split, time_col, name, freq, target, prof)

"""Train a text classifier, measure it, keep it, score texts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from tidegauge.operators.model import (
    accuracy, fit_text_classifier, roc_auc_ovo, split_by_hash,
)
from tidegauge.sources.artifacts import save_model


def train(docs: DataFrame, id_col: str, text: str, target: str, max_iter: int = 500,
          root: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit on a 75 % hash split; returns the model and ``part, accuracy`` for both parts.

    With ``root`` the model is stored under ``sentiment_analysis_model``.
    """
    tagged = split_by_hash(docs.select(id_col, text, target), [id_col])
    model = fit_text_classifier(tagged.where("part = 'train'"), text, target, max_iter=max_iter)
    if root:
        save_model(model, root, "sentiment_analysis_model")
    scored = model.transform(tagged).select("part", target, "prediction")
    return model, accuracy(scored, target, "prediction", ["part"])


def auc(model: PipelineModel, docs: DataFrame, target: str, classes: list[int]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(docs).select(F.col(target).cast("int").alias("y"),
                                          vector_to_array("probability").alias("scores"))
    return roc_auc_ovo(scored, "y", "scores", classes)

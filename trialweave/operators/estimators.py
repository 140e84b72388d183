"""``fit`` / ``transform`` objects over the statistics engine, for use with ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .blocks import DEFAULT_WIDTH
from .models import Spec, fit, preset, score
from .stats import lagged_stats, total_stats


class StimulusResponse(Estimator):
    """Fits one named or custom model on rows ``(trial, t, x, y)`` of two array columns."""

    def __init__(self, spec: Spec | str, channels: int, features: int, edge: str = "causal", width: int = DEFAULT_WIDTH):
        super().__init__()
        self.spec = preset(spec) if isinstance(spec, str) else spec
        self.channels, self.features, self.edge, self.width = channels, features, edge, width

    def statistics(self, dataset: DataFrame) -> DataFrame:
        st = lagged_stats(dataset, ["trial"], "x", "y", self.spec.x_basis(), self.spec.y_basis(), self.edge, width=self.width)
        return written(st, "trial-stats")

    def _fit(self, dataset: DataFrame) -> "StimulusResponseModel":
        total = total_stats(self.statistics(dataset))
        weights = written(fit(total, [], self.channels, self.features, {"model": self.spec}), "model")
        return StimulusResponseModel(self, weights)


class StimulusResponseModel(Model):
    """Fitted weights; ``transform`` gives the correlation of every trial and component."""

    def __init__(self, parent: StimulusResponse, weights: DataFrame):
        super().__init__()
        self.owner, self.weights = parent, weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        e = self.owner
        p, q = e.channels * e.spec.x_basis().size, e.features * e.spec.y_basis().size
        stats = e.statistics(dataset).withColumn("_one", F.lit(1))
        models = self.weights.withColumn("_one", F.lit(1))
        return score(models, stats, ["_one"], ["trial"], p, q).select("trial", "comp", "r")

"""Models that the charts train, by Spark's own learners."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ranked, with_scalars
from ..functions.storage import erased, written
from .project import scale_columns


def encode_labels(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Distinct labels to 0, 1, ... in ascending order; rows without a label go."""
    labels = ranked(df.select(label).where(F.col(label).isNotNull()).distinct(), label, rank="_place")
    return df.join(labels.select(label, (F.col("_place") - 1).cast("double").alias(out)), label)


def assembled(df: DataFrame, features: list[str], standardise: bool = True) -> DataFrame:
    rows = scale_columns(df, features, deviations=True) if standardise else df
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def linear_fit(df: DataFrame, features: list[str], target: str):
    """The least-squares optimum, which gradient descent on the same loss approaches."""
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal").fit(assembled(df, features, False))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept and r2 of one feature, by one aggregation."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def logistic_fit(df: DataFrame, features: list[str], target: str, rounds: int = 200):
    return LogisticRegression(featuresCol="features", labelCol=target, maxIter=rounds, regParam=0.0).fit(assembled(df, features))


def perceptron_fit(df: DataFrame, features: list[str], target: str, classes: int, hidden: tuple = (64, 32), rounds: int = 100):
    """A classifying network by Spark's own learner, which has no convolutions."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=target, layers=[len(features), *hidden, classes], maxIter=rounds, seed=1).fit(assembled(df, features))


def weights_json(kind: str, weights: dict[str, np.ndarray]) -> str:
    """{model, weights: [{name, shape, data}]}, as all models are handed on."""
    return json.dumps({"model": kind, "weights": [{"name": n, "shape": list(w.shape), "data": [float(x) for x in w.ravel()]} for n, w in weights.items()]})


@dataclass
class Gradients:
    """A linear (one unit) or logistic (a unit under the logistic function) model, trained step by step. history: epoch, loss,
    accuracy (of a logistic one), validation_loss."""

    kind: str
    features: list[str]
    kernel: np.ndarray
    bias: float
    means: np.ndarray
    deviations: np.ndarray
    history: list[dict]

    def to_json(self) -> str:
        return weights_json(self.kind, {"kernel": self.kernel[:, None], "bias": np.array([self.bias])})

    def score(self) -> Column:
        """The prediction as a column over the features' columns, without Python."""
        z = F.lit(float(self.bias))
        for f, w, m, d in zip(self.features, self.kernel, self.means, self.deviations):
            z = z + (F.col(f).cast("double") - float(m)) / float(d) * float(w)
        return 1 / (1 + F.exp(-z)) if self.kind == "logistic" else z


def gradient_fit(df: DataFrame, features: list[str], target: str, key: str, kind: str = "linear", epochs: int = 200, rate: float | None = None, share: float = 0.15, stop: Callable[[dict], bool] | None = None) -> Gradients:
    """Mean squared error of a linear model, or cross-entropy of a logistic one, by gradient steps over all rows, an epoch each, on
    standardised features. A step is one aggregation in the JVM: gradient, losses and hits are sums over the features' columns, and
    the driver sees a row of them. A `share` of rows, by a hash of the key, is kept for validation; after each epoch its record
    joins the history, and `stop` may end the training. Rows with nulls are left out; no rows leave the model as it began."""
    if kind not in ("linear", "logistic"):
        raise ValueError("linear or logistic")
    x = [F.col(f"_{k}") for k in range(len(features))]
    rows = df.select(*(F.col(f).cast("double").alias(f"_{k}") for k, f in enumerate(features)), F.col(target).cast("double").alias("_y"), (F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)).alias("_check")).dropna()
    found = rows.where("not _check").agg(*(f(c) for c in x for f in (F.avg, F.stddev_pop))).first()
    means, deviations = np.array([v or 0.0 for v in found[::2]]), np.array([v or 1.0 for v in found[1::2]])
    rows = written(rows.select(*((c - float(m)) / float(d) for c, m, d in zip(x, means, deviations)), "_y", "_check").toDF(*(f"_{k}" for k in range(len(features))), "_y", "_check"))
    model = Gradients(kind, list(features), np.zeros(len(features)), 0.0, means, deviations, [])
    rate = rate if rate is not None else 0.5 if kind == "logistic" else 0.1
    own = ~F.col("_check")
    for epoch in range(1, epochs + 1):
        z = F.lit(float(model.bias))
        for c, w in zip(x, model.kernel):
            z = z + c * float(w)
        if kind == "logistic":
            p = 1 / (1 + F.exp(-z))
            loss = F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(F.exp(-F.abs(z)))
            error, hit = p - F.col("_y"), (p > 0.5) == (F.col("_y") > 0.5)
        else:
            error, hit = z - F.col("_y"), F.lit(False)
            loss = error * error
            error = 2 * error
        sums = rows.withColumns({"_e": error, "_l": loss, "_h": hit}).agg(F.count_if(own), F.sum(F.when(own, F.col("_l"))), F.count_if(own & F.col("_h")), F.count_if("_check"), F.sum(F.when(F.col("_check"), F.col("_l"))), F.sum(F.when(own, F.col("_e"))), *(F.sum(F.when(own, F.col("_e") * c)) for c in x)).first()
        n, total, hits, n_check, checked, *gradient = sums
        if not n:
            break
        model.bias -= rate * gradient[0] / n
        model.kernel = model.kernel - rate * np.array(gradient[1:]) / n
        record = {"epoch": epoch, "loss": total / n, "accuracy": hits / n if kind == "logistic" else None, "validation_loss": checked / n_check if n_check else None}
        model.history.append(record)
        if stop and stop(record):
            break
    erased(rows)
    return model


@dataclass
class Perceptron:
    """A regressing network: dense layers with rectified units, then one linear unit. history: each epoch's losses."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    means: np.ndarray
    deviations: np.ndarray
    history: list[dict]

    def predicted(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.layers, (x - self.means) / self.deviations)[-1][:, 0]

    def to_json(self) -> str:
        """All that a network needs to predict; `weights_json` gives its weights as other models' are given."""
        return json.dumps({"layers": [{"weights": w.tolist(), "biases": b.tolist()} for w, b in self.layers], "means": self.means.tolist(), "deviations": self.deviations.tolist()})

    def weights_json(self) -> str:
        return weights_json("nonlinear-nn", {f"dense_{k}/{n}": w for k, layer in enumerate(self.layers) for n, w in zip(("kernel", "bias"), layer)})

    @staticmethod
    def from_json(text: str) -> Perceptron:
        raw = json.loads(text)
        return Perceptron([(np.array(p["weights"]), np.array(p["biases"])) for p in raw["layers"]], np.array(raw["means"]), np.array(raw["deviations"]), [])

    def transform(self, df: DataFrame, features: list[str], out: str = "prediction") -> DataFrame:
        """df with a prediction in each row."""
        model = self

        @F.pandas_udf("double")
        def predict(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.predicted(np.stack([c.to_numpy(float) for c in columns], 1)))

        return df.withColumn(out, predict(*(F.col(f).cast("double") for f in features)))


def _forward(layers: list, x: np.ndarray) -> list[np.ndarray]:
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if k + 1 < len(layers) else z)
    return out


def perceptron_regression(df: DataFrame, features: list[str], target: str, key: str, hidden: tuple = (64, 32), epochs: int = 60, rate: float = 0.01, share: float = 0.15, stop: Callable[[dict], bool] | None = None) -> Perceptron:
    """Mean squared error by adaptive gradient steps, one over all rows for each epoch: every partition adds up its gradient, and the
    driver sees sums of the network's size only. A `share` of rows, by a hash of the key, is kept for validation. After each epoch
    its record (epoch, loss, validation_loss) joins the history, and `stop` may end the training. Rows with nulls are left out."""
    rows = df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("_y"), (F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)).alias("_check")).dropna()
    found = rows.where("not _check").agg(*(f(c) for c in features for f in (F.avg, F.stddev_pop))).first()
    means, deviations = np.array([x or 0.0 for x in found[::2]]), np.array([x or 1.0 for x in found[1::2]])
    random, sizes = np.random.default_rng(1), [len(features), *hidden, 1]
    layers = [(random.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    rows = written(rows)
    model = Perceptron(layers, means, deviations, [])
    mean, square = np.zeros(sum(w.size + b.size for w, b in layers)), 0.0

    for epoch in range(1, epochs + 1):
        now = model.layers

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 + sum(w.size + b.size for w, b in now))
            for batch in batches:
                x = (np.stack([batch.column(f).to_numpy() for f in features], 1) - means) / deviations
                y, check = batch.column("_y").to_numpy(), batch.column("_check").to_numpy(zero_copy_only=False)
                out = _forward(now, x)
                error = out[-1][:, 0] - y
                total[:4] += [np.count_nonzero(~check), (error[~check] ** 2).sum(), np.count_nonzero(check), (error[check] ** 2).sum()]
                back, parts = 2 * np.where(check, 0, error)[:, None], []
                for k in range(len(now) - 1, -1, -1):
                    parts[:0] = [(out[k].T @ back).ravel(), back.sum(0)]
                    back = (back @ now[k][0].T) * (out[k] > 0)
                total[4:] += np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

        sums = rows.mapInArrow(gradient, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
        n, loss, n_check, loss_check = sums[:4]
        step = sums[4:] / max(n, 1)
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
        step = rate * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
        at, moved = 0, []
        for w, b in now:
            moved.append((w - step[at : at + w.size].reshape(w.shape), b - step[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        model.layers = moved
        record = {"epoch": epoch, "loss": loss / max(n, 1), "validation_loss": loss_check / n_check if n_check else None}
        model.history.append(record)
        if stop and stop(record):
            break
    return model


def split(df: DataFrame, key: str, share: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, by a hash of the key: the same rows every time."""
    at = F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)
    return df.where(~at), df.where(at)


def partial_dependence(df: DataFrame, model, features: list[str], feature: str, points: int = 60) -> DataFrame:
    """The prediction along one feature, from its least to its greatest value, the others at their means."""
    rest = [f for f in features if f != feature]
    limits = df.agg(F.min(feature).alias("_a"), F.max(feature).alias("_b"), *(F.avg(f).alias(f) for f in rest))
    rows = df.sparkSession.range(points).crossJoin(F.broadcast(limits)).withColumn(feature, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("id") / (points - 1))
    return model.transform(assembled(rows, features, False)).select("id", feature, "prediction")


def decision_surface(df: DataFrame, model, features: list[str], steps: int = 40) -> DataFrame:
    """The prediction over a grid of the first two features, between their bounds, the others at their means. Features are scaled as
    the model's were, by the means and deviations of df's rows."""
    x, y, *rest = features
    scalars = [f(c).alias(f"_{n}_{c}") for c in features for n, f in (("a", F.min), ("b", F.max), ("m", F.avg), ("d", F.stddev_pop))]
    at = lambda c, i: F.col(f"_a_{c}") + (F.col(f"_b_{c}") - F.col(f"_a_{c}")) * i / (steps - 1)
    grid = df.sparkSession.range(steps * steps).crossJoin(F.broadcast(df.agg(*scalars)))
    grid = grid.select(at(x, F.floor(F.col("id") / steps)).alias(x), at(y, F.col("id") % steps).alias(y), *(F.col(f"_m_{c}").alias(c) for c in rest), *(F.col(f"_{n}_{c}") for c in features for n in "md"))
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_d_{c}"))).alias(f"_s_{c}") for c in features]
    rows = VectorAssembler(inputCols=[f"_s_{c}" for c in features], outputCol="features").transform(grid.select(F.col(x), F.col(y), *scaled))
    return model.transform(rows).select(x, y, "prediction")


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(c).alias(c) for c in columns))


def centred(df: DataFrame, column: str, out: str) -> DataFrame:
    return with_scalars(df, F.avg(column).alias("_m")).withColumn(out, F.col(column) - F.col("_m")).drop("_m")

"""Learned operators on pyspark.ml: a linear autoencoder that denoises windows, and a weighted classifier of transits.

The networks that such work usually has need a deep-learning runtime; these keep the operators' contracts with what Spark
has. The denoiser projects a window on the leading components of training windows and back, which is the best linear
autoencoder of that width; the classifier is a logistic regression or a multilayer perceptron over window features.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS_WEIGHTS = {0: 1.0, 1: 5.0}
LATENT = 16


def padded_length(n: int, factor: int = 4) -> int:
    """The next multiple of factor: what a network that halves twice can take."""
    return -(-n // factor) * factor


def pad_right(a: Column, n: int, factor: int = 4) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), padded_length(n, factor) - n))


class Denoiser:
    """fit on clean or noisy windows, then transform; windows keep their length."""

    def __init__(self, latent: int = LATENT):
        self.latent, self.model = latent, None

    def fit(self, samples: DataFrame, col: str = "clean") -> Denoiser:
        self.model = PCA(k=self.latent, inputCol="_v", outputCol="_z").fit(samples.select(array_to_vector(col).alias("_v")))
        return self

    def transform(self, samples: DataFrame, col: str = "noisy", out: str = "denoised") -> DataFrame:
        """Sums of the components, computed by array expressions; the components are as many numbers as latent windows."""
        if self.model is None:
            raise RuntimeError("fit the denoiser first")
        z = self.model.transform(samples.withColumn("_v", array_to_vector(col))).withColumn("_z", vector_to_array("_z"))
        rows = [[float(x) for x in r] for r in self.model.pc.toArray()]
        spark = samples.sparkSession
        parts = spark.createDataFrame([(rows,)], "_pc array<array<double>>")
        back = F.transform("_pc", lambda r: F.aggregate(F.zip_with(r, F.col("_z"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
        return z.crossJoin(F.broadcast(parts)).withColumn(out, back).drop("_v", "_z", "_pc")

    def denoise(self, spark: SparkSession, curves: np.ndarray) -> np.ndarray:
        """Windows as an array of one window, of windows, or of windows with one channel; the result has the same shape. For what fits the driver."""
        shape = np.shape(curves)
        if len(shape) not in (1, 2, 3) or (len(shape) == 3 and shape[2] != 1):
            raise ValueError(f"windows of shape {shape}; give (n,), (windows, n) or (windows, n, 1)")
        rows = np.reshape(np.asarray(curves, float), (1, -1) if len(shape) == 1 else (shape[0], -1))
        d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, noisy array<double>")
        got = {r["i"]: r["denoised"] for r in self.transform(d).select("i", "denoised").collect()}
        return np.array([got[i] for i in range(len(rows))]).reshape(shape)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Denoiser:
        model = PCAModel.load(path)
        out = cls(model.getK())
        out.model = model
        return out


def window_features(samples: DataFrame, col: str = "noisy", parts: int = 16) -> DataFrame:
    """samples with features: the means and minima of equal parts of a window, and its spread."""
    a, n = F.col(col), F.size(F.col(col))
    piece = lambda k: F.slice(a, (F.floor(n * k / parts) + 1).cast("int"), (F.floor(n * (k + 1) / parts) - F.floor(n * k / parts)).cast("int"))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(x), F.lit(1))
    values = [f for k in range(parts) for f in (mean(piece(k)), F.array_min(piece(k)))]
    return samples.withColumn("features", F.array(*(F.coalesce(v, F.lit(0.0)) for v in values), F.array_max(a) - F.array_min(a)))


def train_classifier(samples: DataFrame, kind: str = "logistic", weights: dict[int, float] = CLASS_WEIGHTS, seed: int = 42, iterations: int = 50) -> PipelineModel:
    """A classifier of samples(features, label). Class weights weigh a row's loss; the perceptron, which takes no weights, gets rows repeated by whole weights."""
    d = samples.withColumns({"_f": array_to_vector("features"), "_w": F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])})
    scaler = StandardScaler(inputCol="_f", outputCol="_x", withMean=True)
    if kind == "logistic":
        stage = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=iterations, regParam=1e-3)
    elif kind == "perceptron":
        d = d.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.greatest(F.round("_w"), F.lit(1)).cast("int")))).drop("_again")
        width = len(samples.select("features").first()[0])
        stage = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="label", layers=[width, 16, 2], maxIter=iterations, seed=seed)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return Pipeline(stages=[scaler, stage]).fit(d)


def predict(model: PipelineModel, samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """samples with y_prob, the chance of a transit, and y_pred."""
    d = model.transform(samples.withColumn("_f", array_to_vector("features")))
    return d.withColumn("y_prob", vector_to_array("probability")[1]).withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int")).select(*samples.columns, "y_prob", "y_pred")

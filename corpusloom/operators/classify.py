"""Multinomial softmax classification of dense vectors with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

# Training settings.
EPOCHS, L2 = 200, 1e-3


def train(vectors: DataFrame, epochs: int = EPOCHS, l2: float = L2) -> LogisticRegressionModel:
    """Fit ``(vector, label)``; the model carries the loss curve and training accuracy."""
    if vectors.select("label").distinct().limit(2).count() < 2:
        raise ValueError("training needs at least two classes")
    rows = vectors.select(
        array_to_vector("vector").alias("features"), F.col("label").cast("double").alias("label")
    )
    return LogisticRegression(
        family="multinomial", regParam=l2, maxIter=epochs, standardization=False
    ).fit(rows)


def loss_curve(model: LogisticRegressionModel, spark) -> DataFrame:
    history = [(i, float(x)) for i, x in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(history, "epoch int, loss double")


def classify(model: LogisticRegressionModel, vectors: DataFrame) -> DataFrame:
    """The most probable class of each vector, with ``1 - p`` as distance per class."""
    scored = model.transform(vectors.withColumn("features", array_to_vector("vector")))
    kept = [c for c in vectors.columns if c != "vector"]
    return scored.select(
        *kept,
        F.col("prediction").cast("int").alias("predicted"),
        F.transform(vector_to_array("probability"), lambda p: 1 - p).alias("distances"),
    )


def coefficients(model: LogisticRegressionModel, spark) -> DataFrame:
    """``(class, intercept, weights)``: a row per class, as it is stored beside the vectors."""
    rows = [
        (k, float(intercept), [float(w) for w in weights])
        for k, (intercept, weights) in enumerate(
            zip(model.interceptVector, model.coefficientMatrix.toArray())
        )
    ]
    return spark.createDataFrame(rows, "class int, intercept double, weights array<double>")


def probabilities(table: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows with ``probabilities``, an array of ``(class, p)`` by class, from stored
    coefficients. Their size is classes x dimensions; every row meets all of them."""
    rows = F.array_sort(F.collect_list(F.struct("class", "intercept", "weights"))).alias("m")
    model = table.agg(rows).scalar()

    def logit(row):
        products = F.zip_with(row["weights"], F.col("vector"), lambda w, x: w * x)
        return row["intercept"] + F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

    logits = F.transform("_m", lambda r: F.struct(r["class"].alias("class"), logit(r).alias("z")))
    with_logits = vectors.withColumn("_m", model).withColumn("_z", logits)
    # the largest logit is taken off, so that no power overflows
    top = F.array_max(F.transform("_z", lambda r: r["z"]))
    powers = F.transform(
        "_z", lambda r: F.struct(r["class"].alias("class"), F.exp(r["z"] - F.col("_top")).alias("e"))
    )
    total = F.aggregate("_e", F.lit(0.0), lambda a, r: a + r["e"])
    shares = F.transform(
        "_e", lambda r: F.struct(r["class"].alias("class"), (r["e"] / F.col("_total")).alias("p"))
    )
    return (
        with_logits.withColumn("_top", top)
        .withColumn("_e", powers)
        .withColumn("_total", total)
        .withColumn("probabilities", shares)
        .drop("_m", "_z", "_top", "_e", "_total")
    )


def classify_by_table(table: DataFrame, vectors: DataFrame) -> DataFrame:
    """``predicted`` (of equal classes the smallest) and its ``distance`` 1 - p."""
    best = F.array_max(
        F.transform("probabilities", lambda r: F.struct(r["p"].alias("p"), (-r["class"]).alias("c")))
    )
    return (
        probabilities(table, vectors)
        .withColumn("_best", best)
        .withColumn("predicted", (-F.col("_best.c")).cast("int"))
        .withColumn("distance", 1 - F.col("_best.p"))
        .drop("_best", "probabilities", "vector")
    )


def loss_gradient(table: DataFrame, vectors: DataFrame, l2: float = L2) -> DataFrame:
    """``(class, i, gradient)`` of the penalised mean loss; ``i`` is -1 for the intercept.

    Every row adds its residual times its vector to the sums of a class; the sums are partial before
    they are shuffled, and there are classes x dimensions of them.
    """
    residual = (
        probabilities(table, vectors)
        .select("label", "vector", F.explode("probabilities").alias("r"))
        .select(
            F.col("r.class").alias("class"),
            (F.col("r.p") - (F.col("label") == F.col("r.class")).cast("double")).alias("d"),
            F.concat(F.array(F.lit(1.0)), "vector").alias("x"),
        )
    )
    means = (
        residual.select("class", "d", F.posexplode("x").alias("at", "value"))
        .groupBy("class", "at")
        .agg(F.avg(F.col("d") * F.col("value")).alias("mean"))
    )
    weights = table.select("class", F.posexplode("weights").alias("i", "w"))
    return (
        means.withColumn("i", F.col("at") - 1)
        .join(F.broadcast(weights), ["class", "i"], "left")
        .select("class", "i", (F.col("mean") + l2 * F.coalesce("w", F.lit(0.0))).alias("gradient"))
    )

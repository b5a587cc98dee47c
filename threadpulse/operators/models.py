"""Model operators on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(numeric: list[str], categories: list[str]) -> list:
    """Stages that turn numbers (null: 0) and categories (unknown: own slot) into `features`; fill nulls before."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categories]
    hot = [OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], handleInvalid="keep")] if categories else []
    return [*index, *hot, VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categories]], outputCol="features", handleInvalid="keep")]


def forest_scores(frame: DataFrame, label: str, numeric: list[str], split: str, at: int, trees: int = 30, depth: int = 6) -> DataFrame:
    """Random forest trained on rows before `at` of the split column, class-balanced; scores of the rows from it on."""
    data = frame.fillna(0, numeric).withColumn("label", F.col(label).cast("double")).withColumn(split, F.col(split))
    train, test = data.where(F.col(split) < at), data.where(F.col(split) >= at)
    n = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    pos = max(1.0, n["p"] or 0.0)
    weight = F.when(F.col("label") == 1, (n["n"] or 1) / (2 * pos)).otherwise((n["n"] or 1) / (2 * max(1.0, (n["n"] or 1) - pos)))
    model = Pipeline(stages=[*assemble(numeric, []), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, weightCol="w")]).fit(train.withColumn("w", weight))
    from pyspark.ml.functions import vector_to_array

    return model.transform(test.withColumn("w", F.lit(1.0))).select(*frame.columns, F.element_at(vector_to_array("probability"), -1).alias("score"))


def text_clusters(frame: DataFrame, words: str, k: int = 5, features: int = 1 << 12) -> DataFrame:
    """TF-IDF vectors of word arrays, normalized, in k clusters."""
    stages = [HashingTF(inputCol=words, outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf", minDocFreq=2), Normalizer(inputCol="idf", outputCol="features"), KMeans(k=k, seed=42, maxIter=10)]
    return Pipeline(stages=stages).fit(frame).transform(frame).drop("tf", "idf", "features").withColumnRenamed("prediction", "cluster")

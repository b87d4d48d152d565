"""Feature tables and models of Spark ML, with contributions of features to single predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(train: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 1):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def folds(df: DataFrame, key: str, n: int = 2, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """(the other folds, the fold) for each of n folds by a hash of key: rows with one key are in one fold, nulls too."""
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n))
    return [(df.where(at != k), df.where(at == k)) for k in range(n)]


def out_of_fold(df: DataFrame, key: str, use: Callable[[DataFrame, DataFrame], DataFrame], n: int = 2, seed: int = 0) -> DataFrame:
    """What use(train, rest) gives for all rows, each as one of the rest: no row is scored by a model that has seen it or another of its key."""
    return reduce(DataFrame.unionByName, [use(train, rest) for train, rest in folds(df, key, n, seed)])


def chance(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, prediction, chance of class 1)."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, "prediction", F.element_at(vector_to_array("probability"), 2).alias("chance"))


def _nodes(tree) -> list[dict]:
    """A decision tree as a list of nodes; children are places in it."""
    out: list[dict] = []

    def add(node) -> int:
        at = len(out)
        out.append({})
        stats = list(node.impurityStats().stats())
        out[at] = {"value": stats[1] / sum(stats) if sum(stats) else 0.0, "feature": -1}
        if node.subtreeDepth() > 0:
            split = node.split()
            out[at] |= {"feature": split.featureIndex(), "threshold": split.threshold(), "left": add(node.leftChild()), "right": add(node.rightChild())}
        return at

    add(tree._call_java("rootNode"))
    return out


def contributions(model, df: DataFrame, key: str, features: list[str], least: float = 0.01) -> DataFrame:
    """(key, feature, contribution): along each tree's path the change of the mean at a split belongs to its feature; trees are
    averaged, small values left out. Trees are few and of fixed depth and go to all executors."""
    trees = [_nodes(t) for t in model.stages[-1].trees]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                sums = [0.0] * len(features)
                for nodes in trees:
                    at = 0
                    while nodes[at]["feature"] >= 0:
                        n = nodes[at]
                        to = n["left"] if row[1 + n["feature"]] <= n["threshold"] else n["right"]
                        sums[n["feature"]] += (nodes[to]["value"] - n["value"]) / len(trees)
                        at = to
                out += [(row[0], f, v) for f, v in zip(features, sums, strict=True) if abs(v) >= least]
            yield pd.DataFrame(out, columns=["key", "feature", "contribution"])

    kind = dict(df.dtypes)[key]
    return df.select(key, *features).mapInPandas(run, f"key {kind}, feature string, contribution double").withColumnRenamed("key", key)


def boosted_chain(train: DataFrame, test: DataFrame, features: list[str], steps: list[str], target: str, rounds: int = 10, seed: int = 1) -> DataFrame:
    """test with a prediction of target: a model for each step, whose predictions are features of the last one."""
    used = list(features)
    for i, label in enumerate([*steps, target]):
        name = "prediction" if label == target and i == len(steps) else f"guess_{label}"
        model = Pipeline(stages=[VectorAssembler(inputCols=used, outputCol=f"v{i}", handleInvalid="skip"), GBTRegressor(featuresCol=f"v{i}", labelCol=label, predictionCol=name, maxIter=rounds, maxDepth=3, seed=seed)]).fit(train.where(F.col(label).isNotNull()))
        train, test = model.transform(train), model.transform(test)
        used.append(name)
    return test


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    stages = [StringIndexer(inputCols=columns, outputCols=[f"{c}_index" for c in columns], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_hot" for c in columns])]
    return Pipeline(stages=stages).fit(df).transform(df)


def best_of(train: DataFrame, features: list[str], label: str, grid: dict[str, list], seed: int = 1, share: float = 0.75):
    """The forest with the best F1 on held-out rows over all combinations of a grid."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    model = RandomForestClassifier(labelCol=label, seed=seed)
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(model.getParam(name), values)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model])
    search = TrainValidationSplit(estimator=pipeline, estimatorParamMaps=build.build(), evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"), trainRatio=share, seed=seed)
    return search.fit(train).bestModel


def permutation_importance(model, df: DataFrame, features: list[str], label: str, seed: int = 1) -> list[tuple[str, float]]:
    """Loss of accuracy when one feature's values are dealt to other rows, for each feature. Values are dealt by a join of hash ranks
    within buckets, so no task holds a column."""
    from pyspark.sql import Window

    share = lambda d: model.transform(d).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    whole = share(df)
    out = []
    for f in features:
        bucket = F.pmod(F.xxhash64(label, *features), F.lit(64))
        here = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.struct(*df.columns), F.lit(seed)))))
        there = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.struct(*df.columns), F.lit(seed + 1))))).select("_b", "_r", F.col(f).alias("_v"))
        dealt = here.join(there, ["_b", "_r"]).withColumn(f, F.col("_v")).drop("_b", "_r", "_v")
        out.append((f, whole - share(dealt)))
    return out

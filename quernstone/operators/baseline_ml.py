"""Bag-of-words baseline: tokens, counts, random forest, search, and its report."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StringIndexer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.operators.balance import stratified_split

WORD = r"\b\w\w+\b"


def words(df: DataFrame, text: str, out: str = "words") -> DataFrame:
    """Lower-case words of two characters and more."""
    return RegexTokenizer(inputCol=text, outputCol=out, pattern=WORD, gaps=False, toLowercase=True).transform(df)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n, rows) over all rows: what the vectoriser's vocabulary is made of."""
    each = words(df.select(text), text).withColumn("__r", F.monotonically_increasing_id()).select("__r", F.explode("words").alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("__r").alias("rows"))


def encode_labels(df: DataFrame, labels: str = "label") -> DataFrame:
    """Adds label_index in alphabetic order."""
    return StringIndexer(inputCol=labels, outputCol="label_index", stringOrderType="alphabetAsc").fit(df).transform(df)


def forest(text: str, target: str, trees: int = 50, depth: int = 8, vocabulary: int = 1 << 18, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=WORD, gaps=False, toLowercase=True), CountVectorizer(inputCol="__words", outputCol="__features", minDF=1, vocabSize=vocabulary),
        RandomForestClassifier(featuresCol="__features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed),
    ])


def evaluate(df: DataFrame, text: str, target: str, key: str, test: float = 0.2, seed: int = 42, **options) -> DataFrame:
    """(key, target, prediction) of the test part after fitting on the rest."""
    split = stratified_split(df.filter(F.col(text).isNotNull() & F.col(target).isNotNull()), target, test, seed, key)
    model = forest(text, target, seed=seed, **options).fit(split.filter("split = 'train'"))
    return model.transform(split.filter("split = 'test'")).select(key, target, F.col("prediction").cast("int").alias("prediction"))


def search(df: DataFrame, text: str, target: str, trees: Sequence[int] = tuple(range(50, 501, 50)), depths: Sequence[int] = tuple(range(1, 21)), tries: int = 10, folds: int = 5, seed: int = 42):
    """Cross-validated model over `tries` settings drawn at random from trees x depths; folds are at most the rows of the smallest class."""
    least = df.groupBy(target).count().agg(F.min("count").alias("n")).first().n
    pipeline = forest(text, target, seed=seed)
    last = pipeline.getStages()[-1]
    every = [{last.numTrees: t, last.maxDepth: d} for t in trees for d in depths]
    grid = random.Random(seed).sample(every, min(tries, len(every)))
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=target, metricName="f1"), numFolds=max(2, min(folds, least)), seed=seed).fit(df)


def search_table(fitted) -> DataFrame:
    """(trees, depth, f1) of each setting that search() tried."""
    last = fitted.getEstimator().getStages()[-1]
    rows = [(m[last.numTrees], m[last.maxDepth], float(s)) for m, s in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)]
    return SparkSession.active().createDataFrame(rows, "trees int, depth int, f1 double")

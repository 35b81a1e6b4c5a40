"""Fitted models of texts: TF-IDF with a stored vocabulary, support-vector machines with probabilities, and their kernel."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions.spans import bound
from quillframe.scratch import Scratch

from .classify import STOP_WORDS, folds, tokens


@dataclass
class TfIdf:
    """A vocabulary (position, word, df: at most `features` rows, so it is broadcast) and the number of rows that it was fitted on."""

    vocabulary: DataFrame
    rows: int
    stop: list[str]

    @staticmethod
    def fit(df: DataFrame, key: str, text: str, features: int = 500, least_docs: int = 2, stop: list[str] = STOP_WORDS) -> TfIdf:
        """The most frequent words of a corpus, in order of the alphabet; words are counted map-side before any shuffle."""
        counts = df.select(key, F.explode(tokens(F.col(text), stop)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))
        words = counts.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= least_docs).orderBy(F.col("total").desc(), "word").limit(features)
        rows = sorted((r.word, r.df) for r in words.collect())  # `features` rows at most
        table = df.sparkSession.createDataFrame([(i, w, n) for i, (w, n) in enumerate(rows)], "position int, word string, df bigint")
        return TfIdf(table, df.count(), list(stop))

    def save(self, path: str) -> int:
        """Stores the next version under a folder."""
        version = max(_versions(self.vocabulary.sparkSession, path), default=-1) + 1
        self.vocabulary.withColumns({"rows": F.lit(self.rows).cast("bigint"), "stop": F.lit(json.dumps(self.stop))}).coalesce(1).write.parquet(f"{path}/version={version}")
        return version

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> TfIdf:
        table = spark.read.parquet(f"{path}/version={max(_versions(spark, path)) if version is None else version}")
        first = table.select("rows", "stop").first()
        return TfIdf(table.select("position", "word", "df"), first.rows if first else 0, json.loads(first.stop) if first else [])

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, position, word, tf, df, weight): tf * (ln((1 + rows) / (1 + df)) + 1), scaled to length 1 per row."""
        counts = df.select(key, F.explode(tokens(F.col(text), self.stop)).alias("word")).join(F.broadcast(self.vocabulary), "word").groupBy(key, "position", "word", "df").agg(F.count("*").alias("tf"))
        raw = counts.withColumn("raw", F.col("tf") * (F.log((1.0 + self.rows) / (1 + F.col("df"))) + 1))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
        return raw.select(key, "position", "word", "tf", "df", (F.col("raw") / norm).alias("weight"))

    def summaries(self, df: DataFrame, key: str, text: str, most: int = 20) -> DataFrame:
        """(key, keywords: the heaviest words with their weights, vocab_size: words of the vocabulary in the text, vector); rows without such words too."""
        size = self.vocabulary.count()
        listed = self.weights(df, key, text).groupBy(key).agg(F.collect_list(F.struct("position", "word", "weight")).alias("all"))  # `features` items at most
        ranked = F.array_sort(F.transform("all", lambda x: F.struct((-x["weight"]).alias("less"), x["word"].alias("word"))))
        none = F.array().cast("array<struct<position:int,word:string,weight:double>>")
        met = df.select(key).join(listed, key, "left").withColumn("all", F.coalesce("all", none))
        # by position: zeros up to each word, then its weight, so that time goes with the words and the length, not with their product
        placed = F.sort_array(F.transform("all", lambda x: F.struct(x["position"].alias("position"), x["weight"].alias("weight"))))
        part = lambda x, before: F.concat(F.array_repeat(F.lit(0.0), x["position"] - before["position"] - 1), F.array(x["weight"]))
        start = F.struct(F.lit(-1).alias("position"), F.lit(0.0).alias("weight"))
        parts = bound(placed, lambda p: F.zip_with(p, F.slice(F.concat(F.array(start), p), 1, F.size(p)), part))
        last = F.coalesce(F.array_max(F.transform("all", lambda x: x["position"])), F.lit(-1))
        dense = F.concat(F.flatten(parts), F.array_repeat(F.lit(0.0), F.lit(size - 1) - last))
        return met.select(key, F.slice(F.transform(ranked, lambda x: F.struct(x["word"].alias("word"), (-x["less"]).alias("weight"))), 1, most).alias("keywords"), F.size("all").alias("vocab_size"), dense.alias("vector"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def text_features(df: DataFrame, text: str, features: int = 500, label: str | None = None) -> PipelineModel:
    """A saveable pipeline from a text to a TF-IDF vector `_f` of length 1 (and a label to `_label`).

    Spark's IDF is the logarithm alone; the weights that TF-IDF multiplies with are that plus 1, so the fitted logarithms become a fixed product.
    """
    stages = [StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)] if label else []
    stages += _cutters(text)
    return PipelineModel([*stages, *_weighers(PipelineModel(stages).transform(df), features)])


def _cutters(text: str) -> list:
    """From a text to its words `_t`."""
    return [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[A-Za-z0-9_]{2,}", gaps=False), StopWordsRemover(inputCol="_w", outputCol="_t", stopWords=STOP_WORDS)]


def _weighers(cut: DataFrame, features: int) -> list:
    """From words `_t` to the vector `_f`, fitted."""
    counter = CountVectorizer(inputCol="_t", outputCol="_tf", vocabSize=features, minDF=2.0).fit(cut)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(cut))
    plus = ElementwiseProduct(inputCol="_tf", outputCol="_idf", scalingVec=Vectors.dense(idf.idf.toArray() + 1))
    return [counter, plus, Normalizer(inputCol="_idf", outputCol="_f")]


def fourier_features(df: DataFrame, columns: list[str], wide: int = 200, seed: int = 42) -> tuple[PipelineModel, Column]:
    """Scaled columns and random Fourier features of them, whose products approach the kernel exp(-gamma d^2): (pipeline to `_s`, vector column).

    gamma is 1 / (columns * variance of all scaled values), which is 1 / columns where no column is constant.
    """
    assembled = VectorAssembler(inputCols=columns, outputCol="_a", handleInvalid="skip")
    scaler = StandardScaler(inputCol="_a", outputCol="_s", withMean=True, withStd=True).fit(assembled.transform(df))
    varying = sum(s > 0 for s in scaler.std.toArray())
    rng, n = np.random.default_rng(seed), len(columns)
    gamma = 1 / (n * max(varying / n, 1e-9))
    turns, shifts = rng.normal(0, math.sqrt(2 * gamma), (wide, n)), rng.uniform(0, 2 * math.pi, wide)
    v = vector_to_array(F.col("_s"))
    parts = [F.cos(sum((F.get(v, F.lit(i)) * float(t[i]) for i in range(n)), F.lit(float(b)))) * math.sqrt(2 / wide) for t, b in zip(turns, shifts)]
    return PipelineModel([assembled, scaler]), array_to_vector(F.array(*parts))


@dataclass
class CalibratedSvm:
    """A linear support-vector machine per label (one for two labels) and a sigmoid for its margins."""

    labels: list[str]
    machines: list[LinearSVCModel]
    sigmoids: list[tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, label: str, key: str, vector: str = "_f", c: float = 1.0, k: int = 3, seed: int = 42, iterations: int = 20) -> CalibratedSvm:
        """df: label, key and a vector. Sigmoids are fitted to the margins of rows that a machine has not seen (k folds)."""
        labels = sorted(r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().collect())  # the labels
        known = df.filter(F.col(label).isNotNull())
        dealt = folds(known.select(label, key, vector), label, key, k, seed).cache()
        total = dealt.count()
        machines, sigmoids = [], []
        for one in labels[1:] if len(labels) == 2 else labels:
            mine = dealt.withColumn("_y", (F.col(label) == one).cast("double"))

            def trained(rows: DataFrame, n: int) -> LinearSVCModel:
                return LinearSVC(featuresCol=vector, labelCol="_y", rawPredictionCol="_raw", predictionCol="_p", maxIter=iterations, tol=1e-3, regParam=1 / (c * max(n, 1)), standardization=False).fit(rows)

            seen = None
            for i in range(k):
                part = _margin(trained(mine.filter(F.col("fold") != i), total * (k - 1) // k), mine.filter(F.col("fold") == i)).select("_y", "_m")
                seen = part if seen is None else seen.unionByName(part)
            sigmoids.append(_sigmoid(seen))
            machines.append(trained(mine, total))
        dealt.unpersist()
        return CalibratedSvm(labels, machines, sigmoids)

    def probabilities(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        """Adds a map label -> probability; each label's sigmoid, scaled so that they add up to 1."""
        out, cols = df, []
        for i, (machine, (a, b)) in enumerate(zip(self.machines, self.sigmoids)):
            out = _margin(machine, out).withColumnRenamed("_m", f"_m{i}").drop("_raw", "_p")
            cols.append(1 / (1 + F.exp(F.col(f"_m{i}") * a + b)))
        if len(self.labels) == 2:
            cols = [1 - cols[0], cols[0]]
        whole = sum(cols, F.lit(0.0))
        shares = [F.when(whole > 0, p / whole).otherwise(1 / max(len(cols), 1)) for p in cols]
        pairs = [x for label, p in zip(self.labels, shares) for x in (F.lit(label), p)]
        made = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        return out.withColumn(name, made).drop(*[f"_m{i}" for i in range(len(self.machines))])

    def save(self, path: str, spark: SparkSession) -> None:
        rows = [(i, json.dumps({"labels": self.labels, "sigmoid": s})) for i, s in enumerate(self.sigmoids)]
        spark.createDataFrame(rows, "position int, spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        for i, machine in enumerate(self.machines):
            machine.write().overwrite().save(f"{path}/machine={i}")

    @staticmethod
    def load(path: str, spark: SparkSession) -> CalibratedSvm:
        specs = [json.loads(r.spec) for r in spark.read.parquet(f"{path}/spec").orderBy("position").collect()]  # one row a label
        return CalibratedSvm(specs[0]["labels"], [LinearSVCModel.load(f"{path}/machine={i}") for i in range(len(specs))], [tuple(s["sigmoid"]) for s in specs])


def _margin(machine: LinearSVCModel, df: DataFrame) -> DataFrame:
    return machine.transform(df).withColumn("_m", F.get(vector_to_array("_raw"), F.lit(1)))


def _sigmoid(seen: DataFrame) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a m + b)) for margins `_m` and truth `_y`, whose targets are drawn in a little from 0 and 1, so that few rows don't make it a step."""
    n = seen.agg(F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)).first()
    up, down = (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2)
    share = F.when(F.col("_y") == 1, up).otherwise(down)
    both = seen.select(array_to_vector(F.array("_m")).alias("_v"), F.explode(F.array(F.struct(F.lit(1.0).alias("t"), share.alias("w")), F.struct(F.lit(0.0).alias("t"), (1 - share).alias("w")))).alias("x")).select("_v", "x.*")
    fit = LogisticRegression(featuresCol="_v", labelCol="t", weightCol="w", maxIter=50, standardization=False).fit(both)
    return -float(fit.coefficients[0]), -float(fit.intercept)


def calibrated_predictions(df: DataFrame, label: str, key: str, text: str, k: int = 3, features: int = 500, seed: int = 42) -> DataFrame:
    """(key, fold, label, probabilities): each fold by vocabulary, machines and sigmoids of the others."""
    cut = PipelineModel(_cutters(text)).transform(df.select(label, key, text)).select(label, key, "_t")
    dealt, out = Scratch(df.sparkSession, "folds").keep(folds(cut, label, key, k, seed), "dealt"), None  # cut and dealt once for all fits
    for i in range(k):
        rest = dealt.filter(F.col("fold") != i)
        words = PipelineModel(_weighers(rest, features))
        model = CalibratedSvm.fit(words.transform(rest).select(label, key, "_f"), label, key, k=k, seed=seed + 1)
        part = model.probabilities(words.transform(dealt.filter(F.col("fold") == i))).select(key, "fold", label, "probabilities")
        out = part if out is None else out.unionByName(part)
    return out

"""Text classification: features, TF-IDF, folds, prediction with a reject option, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English stop words of the TF-IDF features.
STOP_WORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down
during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off
on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under
until up very was we were what when where which while who whom why will with you your
""".split()


def tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case words of two or more ASCII word characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def tf_idf(df: DataFrame, key: str, text: str, features: int = 500, least_docs: int = 2, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(key, word, tf, df, weight): tf * (ln((1 + n) / (1 + df)) + 1) over the most frequent words, scaled to length 1 per row.

    The vocabulary, `features` words at most, is broadcast; with the usual `least_docs` it is found before words are counted per row, so that
    only its words are shuffled with their rows.
    """
    n = df.agg(F.count("*").alias("n"))
    said = df.select(key, F.explode(tokens(F.col(text), stop)).alias("word"))
    if least_docs <= 2 and isinstance(df.schema[key].dataType, T.IntegralType):  # in two rows or more: the keys of a word differ, or some are missing
        differ = F.lit(True) if least_docs < 2 else (F.min(key) < F.max(key)) | ((F.count(key) > 0) & (F.count(key) < F.count("*")))
        often = said.groupBy("word").agg(F.count("*").alias("total"), differ.alias("differ")).filter("differ").orderBy(F.col("total").desc(), "word").limit(features)
        said = said.join(F.broadcast(often.select("word")), "word")
    counts = said.groupBy(key, "word").agg(F.count("*").alias("tf"))
    vocabulary = counts.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= least_docs)
    vocabulary = vocabulary.orderBy(F.col("total").desc(), "word").limit(features).select("word", "df")
    raw = counts.repartition(key).join(F.broadcast(vocabulary.join(F.broadcast(n))), "word").withColumn("raw", F.col("tf") * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1))  # n: one row; dealt before there are more columns
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "word", "tf", "df", (F.col("raw") / norm).alias("weight"))


def top_words(weights: DataFrame, key: str, most: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("weight").desc(), "word"))
    return weights.filter("weight > 0").withColumn("rank", rank).filter(F.col("rank") <= most)


def mean_vector(df: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean of vectors per key, scaled to length 1."""
    w = F.col(weight) if weight else F.lit(1.0)
    flat = df.select(key, w.alias("w"), F.posexplode(vector).alias("i", "v"))
    mean = flat.groupBy(key, "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    listed = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)) + 1e-10
    return listed.withColumn("unit", F.transform("mean", lambda x: x / norm))


def with_reject(probabilities: Column, least: float = 0.6) -> Column:
    """(label, confidence) of a map label -> probability: the largest (the first label by name among equals), Unknown under `least`."""
    entries = F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label")))
    top = F.array_max(F.transform(entries, lambda e: e["p"]))
    first = F.array_min(F.transform(F.filter(entries, lambda e: e["p"] == top), lambda e: e["label"]))
    return F.struct(F.when(top >= least, first).otherwise("Unknown").alias("label"), top.alias("confidence"))


def consensus(svm: Column, other: Column, unknown_is_missing: bool = False) -> Column:
    missing = ["", "unavailable", *(["Unknown"] if unknown_is_missing else [])]
    return F.when(svm.isNull() | svm.isin(missing), other).otherwise(svm)


def normal_label(label: Column) -> Column:
    return F.when(F.contains(F.lower(label), F.lit("state eligibility")), "State Eligibility").otherwise(F.trim(label))


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: stratified by label, dealt by a seeded hash. Salted ranks keep a label of any size off a single task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64)))
    counts = salted.groupBy(label, "_salt").count()
    before = counts.select(label, "_salt", (F.sum("count").over(Window.partitionBy(label).orderBy("_salt")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(label, "_salt").orderBy(F.xxhash64(key, F.lit(seed)), key))
    ranked = salted.withColumn("_in", inside).join(before, [label, "_salt"])
    return ranked.withColumn("fold", F.pmod(F.col("_before") + F.col("_in") - 1, F.lit(k)).cast("int")).drop("_salt", "_in", "_before")


def metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy overall and of what was committed to, and how much was Unknown; one row."""
    right, unknown = F.col(truth) == F.col(predicted), F.col(predicted) == "Unknown"
    n, u = F.count("*"), F.count_if(unknown)
    return df.agg(n.alias("n"), (F.count_if(right) / n).alias("accuracy"), u.alias("unknown"), (u / n).alias("unknown_rate"), (F.count_if(right & ~unknown) / F.nullif(n - u, F.lit(0))).alias("committed_accuracy"))


def oov_rate(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """One row: the mean, over rows with tokens, of the share of a row's tokens that the vocabulary (column word, distinct) lacks."""
    words = df.select(key, F.posexplode(tokens(F.col(text), [])).alias("_p", "word"))
    known = words.join(vocabulary.select("word", F.lit(1).alias("_known")), "word", "left")
    per = known.groupBy(key).agg((1 - F.count("_known") / F.count("*")).alias("_rate"))
    return per.agg(F.count("*").alias("rows"), F.avg("_rate").alias("oov_rate"))


def fold_summary(df: DataFrame, fold: str, truth: str, predicted: str) -> DataFrame:
    """One row over the folds of a cross-validation: mean, (population) deviation, least and greatest accuracy."""
    per = df.groupBy(fold).agg((F.count_if(F.col(truth) == F.col(predicted)) / F.count("*")).alias("_accuracy"))
    return per.agg(F.count("*").alias("folds"), F.avg("_accuracy").alias("mean"), F.stddev_pop("_accuracy").alias("std"), F.min("_accuracy").alias("min"), F.max("_accuracy").alias("max"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label; one pass over the rows."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("claimed"), F.sum("hit").alias("hits"))
    precision, recall = F.coalesce(F.col("hits") / F.nullif(F.col("claimed"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    both = per.select("label", "support", precision.alias("precision"), recall.alias("recall"))
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def document_features(tables: Column, text_words: Column) -> dict[str, Column]:
    """Rows of tables, the share of all words that are in tables, cells per row; tables: array of tables of rows of cells."""
    rows = F.flatten(tables)
    cells = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(r))
    in_tables = F.aggregate(F.flatten(rows), F.lit(0), lambda a, c: a + F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+"))))
    words = text_words + in_tables
    return {"table_row_count": F.size(rows), "table_text_ratio": F.when(words > 0, in_tables / words).otherwise(0.0), "avg_cells_per_row": F.when(F.size(rows) > 0, cells / F.size(rows)).otherwise(0.0)}


def fit_scale(train: DataFrame, features: list[str]) -> DataFrame:
    """One row of means and (population) deviations, from the training rows only."""
    return train.agg(*[x for f in features for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))])


def scale(df: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """Features in deviations from the mean; a constant feature becomes 0."""
    joined = df.join(F.broadcast(fitted))  # one row
    return joined.withColumns({f: F.when(F.col(f"{f}_std") > 0, (F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_std")).otherwise(0.0) for f in features}).drop(*fitted.columns)


def train_logistic(df: DataFrame, label: str, text: str, features: int = 500, c: float = 1.0):
    """TF-IDF with logistic regression as a saveable pipeline (hashing-free, fitted on the given rows only); the penalty is that of C = c, whatever the number of rows."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression

    from .learn import text_features

    words = text_features(df, text, features, label)
    ready = words.transform(df)
    model = LogisticRegression(featuresCol="_f", labelCol="_label", maxIter=100, tol=1e-4, family="multinomial", regParam=1 / (c * max(ready.count(), 1)), standardization=False).fit(ready)
    return PipelineModel([*words.stages, model])


def train_linear_svm(df: DataFrame, label: str, text: str, features: int = 500, c: float = 1.0):
    """TF-IDF with a linear support-vector machine per label against the rest, as a saveable pipeline of margins; `learn.CalibratedSvm` gives probabilities."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LinearSVC, OneVsRest

    from .learn import text_features

    words = text_features(df, text, features, label)
    ready = words.transform(df)
    model = OneVsRest(classifier=LinearSVC(maxIter=50, tol=1e-3, regParam=1 / (c * max(ready.count(), 1)), standardization=False), featuresCol="_f", labelCol="_label").fit(ready)
    return PipelineModel([*words.stages, model])


def predicted_label(fitted, df: DataFrame, name: str = "predicted") -> DataFrame:
    """Adds the label that a fitted pipeline predicts."""
    from pyspark.ml.feature import IndexToString

    labels = fitted.stages[0].labels
    out = IndexToString(inputCol="prediction", outputCol=name, labels=[*labels, "Unknown"]).transform(fitted.transform(df))
    return out.select(*df.columns, name)


def cross_validated(df: DataFrame, label: str, key: str, text: str, train=train_logistic, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold and predicted: each fold is predicted by a model of the others (k fits, k a small constant). See fold_summary."""
    dealt, out = folds(df, label, key, k, seed), None
    for i in range(k):
        part = predicted_label(train(dealt.filter(F.col("fold") != i), label, text), dealt.filter(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out

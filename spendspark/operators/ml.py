"""Text classifier for claim categories on MLlib."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, IDFModel, NGram, Normalizer, RegexTokenizer, SQLTransformer,
    StopWordsRemover, StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions.scalars import moment
from spendspark.operators.categorize import claim_text, with_final_choice, with_service_scores
from spendspark.operators.reports import classification_report
from spendspark.session import cut


def expense_features(claims: DataFrame) -> DataFrame:
    """combined_text, amount_value (unreadable: 0), amount_log, amount_bucket. Bins are
    open below and closed above; 0 and less fall in none."""
    amount = F.coalesce(F.col("amount").cast("string").try_cast("double"), F.lit(0.0))
    bucket = F.when(amount <= 0, F.lit(None).cast("string"))
    for bound, name in fixed.AMOUNT_BINS:
        bucket = bucket.otherwise(name) if bound is None else bucket.when(amount <= bound, name)
    return claims.withColumns({
        "combined_text": claim_text(lower=False), "amount_value": amount,
        "amount_log": F.log1p(amount), "amount_bucket": bucket})


def text_stages() -> list:
    """Lower-case word tokens of two characters or more, English stop words out."""
    return [
        RegexTokenizer(inputCol="combined_text", outputCol="tokens", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        StopWordsRemover(inputCol="tokens", outputCol="words", locale="en_US"),
    ]


def normalize_text(claims: DataFrame) -> DataFrame:
    """Adds words ARRAY<STRING>: what the classifier sees of a text."""
    stages = Pipeline(stages=text_stages())
    featured = expense_features(claims)
    return stages.fit(featured).transform(featured).drop("tokens")


@dataclass
class Categorizer:
    model: PipelineModel
    labels: list[str]
    version: str
    last_trained: str
    accuracy: float | None
    training_samples: int
    test_samples: int


class InsufficientData(ValueError):
    pass


DRAW_BITS, ROUND_BITS = 60, 15


def draw_of(key: str, seed: int) -> Column:
    """A number of DRAW_BITS bits from the key's MD5: the same in every engine."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def lowest_draws(rows: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """The draw up to which a class has `wanted` rows. rows: class, draw. Each round counts the rows
    of a class by the next ROUND_BITS bits of their draw, behind the bits found so far, and finds the
    count that passes what is wanted: no class is ever sorted, and a round brings one row per class
    to the driver. Two or three rounds tell a billion rows apart, and the last decides in any case."""
    limits = {c: -1 for c, n in wanted.items() if n <= 0}
    found = {c: (0, n) for c, n in wanted.items() if n > 0}  # bits so far, rows still wanted
    for shift in range(DRAW_BITS - ROUND_BITS, -1, -ROUND_BITS):
        if not found:
            break
        look = {name: F.create_map(*[F.lit(x) for c, pair in found.items() for x in (c, pair[i])])[F.col("class")]
                for i, name in enumerate(("bits", "left"))}
        bits = F.shiftright("draw", shift).alias("bits")
        counts = rows.filter(F.shiftright("draw", shift + ROUND_BITS) == look["bits"]).groupBy("class", bits).agg(F.count(F.lit(1)).alias("n"))
        up_to = counts.withColumn("up_to", F.sum("n").over(Window.partitionBy("class").orderBy("bits")))
        passing = up_to.filter(F.col("up_to") >= look["left"]).groupBy("class").agg(F.min(F.struct("bits", "up_to", "n")).alias("at"))
        for row in passing.collect():
            c, at = row["class"], row["at"]
            left = found[c][1]
            if at["up_to"] == left or shift == 0:
                limits[c] = ((at["bits"] + 1) << shift) - 1
                del found[c]
            else:
                found[c] = (at["bits"], left - (at["up_to"] - at["n"]))
    return limits


def stratified_split(samples: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds in_train: of every class of n rows the floor(share * n) rows, one at least, with the lowest
    draws. Rows that repeat a key have one draw and stay together, which may add some. Rows without a
    class go."""
    drawn = cut(samples.select(F.col(label).cast("string").alias("class"), draw_of(key, seed).alias("draw")).filter("class IS NOT NULL"))
    sizes = {r["class"]: r["n"] for r in drawn.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    limits = lowest_draws(drawn, {c: max(1, math.floor(share * n + 1e-9)) for c, n in sizes.items()})
    if not limits:
        return samples.filter("false").withColumn("in_train", F.lit(True))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(label).cast("string")]
    return samples.filter(F.col(label).isNotNull()).withColumn("in_train", draw_of(key, seed) <= limit)


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """w_label and weight of every class: rows of all / (classes * rows of the class)."""
    sizes = train.groupBy(F.col(label).alias("w_label")).agg(F.count(F.lit(1)).alias("n"))
    # one row per class
    return sizes.withColumn("weight", sizes.agg(F.sum("n") / F.count(F.lit(1))).scalar() / F.col("n"))


def with_terms(usable: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """The texts' words and pairs of neighbouring words, in terms."""
    stages = [*text_stages(), NGram(n=2, inputCol="words", outputCol="pairs"),
              SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
    model = Pipeline(stages=stages).fit(usable)
    return model, model.transform(usable)


def term_counts(rows: DataFrame, vocabulary: int | None) -> tuple[CountVectorizerModel | DataFrame, IDFModel | Column, DataFrame]:
    """The vocabulary, its document frequencies and the counts of the rows' terms: the `vocabulary` most
    frequent terms for a model, or with None all that pass the limits, in tables. The share of 80 % is
    given as a number of rows: for a share MLlib keeps all terms in memory and on disk to count the rows."""
    n = rows.count()
    if vocabulary is None:
        return all_term_counts(rows, n)
    most = 0.8 * n
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, minDF=2.0, maxDF=most if most >= 1 else 0.8).fit(rows)
    vectors = counted.transform(rows)
    return counted, IDF(inputCol="tf", outputCol="tf_idf").fit(vectors), vectors


def all_term_counts(rows: DataFrame, n: int) -> tuple[DataFrame, Column, DataFrame]:
    """What term_counts gives, for any number of terms: none is brought to the driver. term and
    document_frequency, the idf as MLlib has it, and the counts as row_number, term, tf."""
    found = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))
    counted = found.filter((F.col("document_frequency") >= 2) & (5 * F.col("document_frequency") <= 4 * n))
    numbered = rows.select("terms", F.monotonically_increasing_id().alias("row_number"))  # before a row becomes several
    long = numbered.select("row_number", F.explode("terms").alias("term"))
    counts = long.groupBy("row_number", "term").agg(F.count(F.lit(1)).alias("tf")).join(counted.select("term"), "term")
    return counted, F.log((n + 1.0) / (F.col("document_frequency") + 1.0)), counts.select("row_number", "term", "tf")


def idf_table(counted: CountVectorizerModel | DataFrame, idf: IDFModel | Column, spark: SparkSession) -> DataFrame:
    """term, document_frequency and smoothed idf plus one, one row per term of the vocabulary."""
    if isinstance(counted, DataFrame):
        return counted.withColumn("idf", idf + 1.0)
    rows = zip(counted.vocabulary, [int(n) for n in idf.docFreq], [float(x) + 1.0 for x in idf.idf.toArray()], strict=True)
    return spark.createDataFrame(list(rows), "term string, document_frequency long, idf double")


def train_categorizer(
    samples: DataFrame, as_of, *, key: str = "id", label: str = "category", labels: list[str] | None = None,
    trees: int = 100, depth: int = 30, vocabulary: int = 1000, seed: int = 42,
) -> tuple[Categorizer, DataFrame]:
    """(categorizer, classification report on the held-out fifth).

    TF-IDF over words and word pairs (at most `vocabulary` terms, in at least two and
    at most 80 % of the texts), random forest with balanced class weights. Trees grow until
    their leaves are of one class; 30 levels are the most that MLlib numbers. Classes are
    `labels`, the nine categories by default; other rows are left out.
    """
    allowed = labels or fixed.CATEGORIES
    usable = expense_features(samples.filter(F.col(label).isin(allowed)))
    # the class counts and weights: one row per class
    counts = usable.groupBy(F.col(label).alias("count_label")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["count_label"]: r["n"] for r in counts.collect()}
    total = sum(sizes.values())
    if total < fixed.FIT_MIN_SAMPLES:
        raise InsufficientData("Insufficient training data (minimum 10 samples required)")

    # version and sample count are those of all rows given, also of classes left out
    given = samples.count()
    # read by the weights, the vocabulary, the idf, the forest and the test: tokenised once
    tokenised, _ = with_terms(usable)
    # what is read again: of training rows the class and the terms, of test rows the claim
    drawn = tokenised.transform(stratified_split(usable, key, label, seed=seed))
    held_out = ~F.col("in_train")
    split = cut(drawn.select(
        *[F.col(c) if c == label else F.when(held_out, F.col(c)).alias(c) for c in usable.columns],
        F.when(F.col("in_train"), F.col("terms")).alias("terms"), "in_train"))
    train, test = split.filter("in_train").select(label, "terms"), split.filter("NOT in_train")
    weights = class_weights(train, label)
    weighted = train.join(F.broadcast(weights), F.col(label) == F.col("w_label")).drop("w_label", "n")
    counted, idf, vectors = term_counts(weighted, vocabulary)
    # smoothed idf plus one, as a fixed scaling of at most `vocabulary` numbers
    scaling = Vectors.dense([x + 1.0 for x in idf.idf.toArray()])
    rest = Pipeline(stages=[
        ElementwiseProduct(inputCol="tf", outputCol="scaled", scalingVec=scaling),
        Normalizer(inputCol="scaled", outputCol="features", p=2.0),
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
    ]).fit(vectors)
    # a task sends the sums of all open nodes however few its rows are: 16,384 rows a task, fewer while cores are idle
    tasks = max(min(samples.sparkSession.sparkContext.defaultParallelism, total // 1024), total // 16384, 1)
    ready = rest.transform(vectors).select("features", "label_index", "weight").coalesce(tasks)
    # deep trees: every row keeps its nodes, else each level sends all trees to the tasks and walks them from the root
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol="label_index", featuresCol="features",
        weightCol="weight", cacheNodeIds=True).fit(ready)
    model = PipelineModel(stages=[*tokenised.stages, counted, *rest.stages[:2], forest])

    indexed = list(rest.stages[2].labels)
    categorizer = Categorizer(model, indexed, f"1.{given}", str(as_of), None, given, 0)
    scored = score_categorizer(categorizer, test.select(*usable.columns))
    report = classification_report(scored, label, "base_category")
    # at most one row per class and three averages
    rows = {r["class"]: r for r in report.collect()}
    categorizer.accuracy = rows["accuracy"]["f1"] if "accuracy" in rows else None
    categorizer.test_samples = int(rows["accuracy"]["support"] or 0) if "accuracy" in rows else 0
    return categorizer, report


def score_categorizer(categorizer: Categorizer | None, claims: DataFrame) -> DataFrame:
    """base_category, base_confidence (highest probability) and base_scores in the
    alphabetical order of the classes; without a model the service's rules."""
    if categorizer is None:
        return with_service_scores(claims)
    kept = claims.columns
    featured = claims if "combined_text" in kept else expense_features(claims)
    scored = categorizer.model.transform(featured)
    probabilities = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in categorizer.labels])
    entries = F.zip_with(names, F.slice(probabilities, 1, len(categorizer.labels)),
                         lambda c, p: F.struct(c.alias("category"), p.alias("score")))
    chosen = F.get(names, F.col("prediction").cast("int"))
    return scored.withColumn("base_scores", entries).select(
        *kept, "base_scores", chosen.alias("base_category"),
        F.array_max(probabilities).alias("base_confidence"))


def suggest_with_model(categorizer: Categorizer | None, claims: DataFrame) -> DataFrame:
    """The full suggestion with the classifier (or the service's rules) as base."""
    method = "machine-learning"
    return with_final_choice(score_categorizer(categorizer, claims)).withColumn("method", F.lit(method))


_METADATA = ("model_version string, last_trained string, accuracy double, categories array<string>, "
             "training_samples long, test_samples long")


def save_model(categorizer: Categorizer, path: str, spark: SparkSession) -> None:
    categorizer.model.write().overwrite().save(f"{path}/model")
    row = (categorizer.version, categorizer.last_trained, categorizer.accuracy, categorizer.labels,
           categorizer.training_samples, categorizer.test_samples)
    spark.createDataFrame([row], _METADATA).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> Categorizer:
    model = PipelineModel.load(f"{path}/model")
    meta = spark.read.schema(_METADATA).json(f"{path}/metadata").first()
    return Categorizer(model, list(meta["categories"]), meta["model_version"], meta["last_trained"],
                       meta["accuracy"], meta["training_samples"], meta["test_samples"])


def training_result(spark: SparkSession, categorizer: Categorizer) -> DataFrame:
    """One row for mutations.record_training."""
    return spark.createDataFrame(
        [(categorizer.training_samples, categorizer.version, categorizer.accuracy)],
        "training_samples long, model_version string, accuracy double")


def model_stats(feedback: DataFrame, categorizer: Categorizer | None = None) -> DataFrame:
    """One row: version, time, accuracy, number of corrections, whether a model exists."""
    version = categorizer.version if categorizer else "1.0"
    return feedback.agg(F.count(F.lit(1)).alias("feedback_count")).select(
        F.lit(version).alias("model_version"),
        F.lit(categorizer.last_trained if categorizer else None).cast("string").alias("last_trained"),
        F.lit(categorizer.accuracy if categorizer else None).cast("double").alias("accuracy"),
        "feedback_count",
        F.array(*[F.lit(c) for c in fixed.CATEGORIES]).alias("categories"),
        F.lit(categorizer is not None).alias("has_trained_model"))


def retrain(expenses: DataFrame, settings: DataFrame, as_of, n: int | None = None, **options):
    """Sample, gate, fit, record: (categorizer, report, settings), or None when fewer
    than 50 samples are there."""
    from spendspark.operators.mutations import record_training
    from spendspark.operators.views import training_sample

    samples = training_sample(expenses, as_of, n)
    if samples.limit(fixed.TRAIN_MIN_SAMPLES).count() < fixed.TRAIN_MIN_SAMPLES:
        return None
    categorizer, report = train_categorizer(samples, as_of, **options)
    recorded = record_training(settings, training_result(expenses.sparkSession, categorizer), as_of)
    return categorizer, report, recorded

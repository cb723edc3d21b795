"""Experiments: a plan and a mode (or a comparison of several) to metric rows.

Features are fitted once per distinct plan, written once, and every fit of the
comparison reads that copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.vectors import nonzero_slots
from scorelens.operators import bayes, explain, logistic
from scorelens.operators.blocked import WrittenLinearModel
from scorelens.operators.counts import class_distribution, majority_baseline
from scorelens.operators.evaluate import accuracy
from scorelens.operators.filters import first_rows, keep_real_comments
from scorelens.operators.labels import with_binary_label, with_score
from scorelens.operators.least_squares import solve_by_group
from scorelens.operators.splits import TEST, TRAIN, hash_split, ordered_split, random_split, test_part, train_part
from scorelens.plans import models
from scorelens.plans.features import (
    DEFAULT_BUCKETS,
    PCA_VOCABULARY,
    PLANS,
    WORDS_ONLY_VOCABULARY,
    FittedFeatures,
    feature_plan,
)
from scorelens.plans.stages import CommentTokenizer, VocabularyCounter
from scorelens.session import settle

METRICS = "plan string, mode string, reg_param double, metric string, value double"
WEIGHTS = "plan string, mode string, bucket double, side string, slot int, feature string, weight double"
COUNTS = "loaded bigint, filtered bigint, limited bigint, train bigint, test bigint"
COMPARISONS = ("all", "bin_class", "multi_class")
CLASS_MODES = ("binary", "bayes", "logistic")
MODES = ("linear", "ridge", "reg", "forest", "sgd", *CLASS_MODES)
SPLITS = {"hash": hash_split, "random": random_split, "ordered": ordered_split}


@dataclass(frozen=True)
class Options:
    """What to run.

    plan: a feature plan, or a comparison: all, bin_class, multi_class.
    mode: linear, ridge, reg, forest, sgd, logistic, bayes or binary.
    lexicon: frame (word, valence), needed by every plan but words.
    fit_on: `all` fits vocabulary, IDF and threshold on all rows; `train` keeps
    the test rows out of them.
    split: `hash` trains on 70 % of the ids, `random` on 70 % of the rows by a
    seeded draw, `ordered` on the first 60 % of rows.
    """

    plan: str = "bag"
    mode: str = "linear"
    reg_param: float = 0.0
    limit: int = -1
    buckets: int | None = DEFAULT_BUCKETS
    lexicon: DataFrame | None = None
    stop_words: Sequence[str] | None = None
    pca_vocabulary: int = PCA_VOCABULARY
    regs: Sequence[float] = models.REG_GRID
    fit_on: str = "all"
    split: str = "hash"

    def __post_init__(self):
        for name, known in (
            ("plan", (*PLANS, *COMPARISONS)),
            ("mode", MODES),
            ("fit_on", ("all", "train")),
            ("split", tuple(SPLITS)),
        ):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}, not {getattr(self, name)!r}")


@dataclass(frozen=True)
class Prepared:
    """A fitted plan with its training and test rows."""

    kind: str
    fitted: FittedFeatures
    train: DataFrame
    test: DataFrame
    featured: DataFrame


@dataclass(frozen=True)
class RowCounts:
    """What the jobs of a run saw on their way: rows loaded, filtered, limited, and in each part.

    The counts come from the jobs that run anyway, none is run for them.
    """

    loaded: Observation
    filtered: Observation
    limited: Observation
    parts: Observation

    @classmethod
    def new(cls) -> RowCounts:
        return cls(*(Observation() for _ in range(4)))

    def frame(self, spark: SparkSession) -> DataFrame:
        found = [o.get for o in (self.loaded, self.filtered, self.limited, self.parts)]
        row = tuple(f[name] for f, names in zip(found, (["n"], ["n"], ["n"], [TRAIN, TEST])) for name in names)
        return spark.createDataFrame([row], COUNTS)


def prepare_rows(comments: DataFrame, options: Options, counts: RowCounts | None = None) -> DataFrame:
    """The rows of an experiment with their part and cleaned tokens, written once: every stage reads that copy.

    `counts` is told how many rows there are at each stage; rows whose score is
    no number leave between the cap and the split.
    """
    counts = counts or RowCounts.new()
    n = F.count(F.lit(1)).alias("n")
    real = keep_real_comments(comments.observe(counts.loaded, n)).observe(counts.filtered, n)
    scored = with_score(first_rows(real, options.limit).observe(counts.limited, n))
    split = SPLITS[options.split](scored)
    in_part = lambda part: F.count_if(F.col("part") == part).alias(part)
    return settle(CommentTokenizer().transform(split).observe(counts.parts, in_part(TRAIN), in_part(TEST)), "tokenized")


def prepare(rows: DataFrame, kind: str, binary: bool, options: Options) -> Prepared:
    """Fit a plan on rows of `prepare_rows` and write its features."""
    plan = feature_plan(
        kind,
        buckets=options.buckets,
        lexicon=options.lexicon,
        tokenized=True,
        binary=binary,
        stop_words=options.stop_words,
        pca_vocabulary=options.pca_vocabulary,
    )
    seen = rows if options.fit_on == "all" else rows.where(F.col("part") == TRAIN)
    fitted = FittedFeatures(plan.fit(seen))
    featured = settle(fitted.featured(rows, "part"), f"features-{kind}")
    return Prepared(kind, fitted, train_part(featured), test_part(featured), featured)


def _weights(data: Prepared, model) -> list[tuple]:
    """(bucket, side, slot, feature, weight) of a fitted model: every bucket's for one-vs-rest."""
    if isinstance(model, WrittenLinearModel):
        ranked = explain.ranked_slots(model.weights())
        names = data.fitted.names_of([slot for _, slot, _ in ranked], model.width)
        return [(None, side, slot, name, weight) for (side, slot, weight), name in zip(ranked, names, strict=True)]
    if hasattr(model, "theta"):
        per_class = {0.0: model.theta.toArray()[0]}
    elif isinstance(model, models.BucketLogistic):
        per_class = model.weights
    elif hasattr(model, "coefficients"):
        per_class = {None: model.coefficients.toArray()}
    else:
        return []
    names = data.fitted.names(len(next(iter(per_class.values()))))
    return [(bucket, *row) for bucket, w in per_class.items() for row in explain.ranked_weights(w, names)]


@dataclass(frozen=True)
class Arm:
    """One fitted model: (reg_param, metric, value) rows and the model."""

    metrics: list[tuple[float, str, float]]
    model: object


def fit_arm(data: Prepared, mode: str, options: Options) -> Arm:
    train, test = data.train, data.test
    if mode in CLASS_MODES:
        if mode == "logistic":
            model, reg = models.fit_logistic(train, options.reg_param), options.reg_param
        else:
            model, reg = models.fit_naive_bayes(train), 0.0
        baseline = majority_baseline(data.featured).first()["baseline"]
        return Arm(
            [(reg, "test_accuracy", models.bucket_accuracy(model, test)), (reg, "majority_share", baseline)],
            model,
        )
    if mode == "reg":
        path = models.regularisation_path(data.featured, options.regs)
        rows = [(reg, "train_rmse", fit) for reg, fit, _ in path]
        return Arm(rows + [(reg, "test_rmse", error) for reg, _, error in path], None)
    if mode == "ridge":
        tuned = models.fit_ridge(train, options.regs)
        model, reg = tuned.model, tuned.reg_param
    elif mode == "forest":
        model, reg = models.fit_forest(train), 0.0
        return Arm([(reg, "test_rmse", models.rmse(model, test))], model)
    elif mode == "sgd":
        model, reg = models.fit_sgd(train), 0.0
    else:
        model, reg = models.fit_linear(train, options.reg_param), options.reg_param
    return Arm(
        [(reg, "train_rmse", models.rmse(model, train)), (reg, "test_rmse", models.rmse(model, test))],
        model,
    )


def _arms(options: Options) -> list[tuple[str, str, bool]]:
    """(plan, mode, binary labels) of each arm, in order."""
    # Two modes bring their own plan, whatever plan was asked for.
    if options.mode in ("binary", "bayes"):
        return [("words", options.mode, options.mode == "binary")]
    if options.plan == "all":
        return [(kind, options.mode, False) for kind in ("bag", "tfidf", "metadata")]
    if options.plan == "bin_class":
        return [("words", "binary", True), ("words", "logistic", True)]
    if options.plan == "multi_class":
        logistic = [(kind, "logistic", False) for kind in ("bag", "tfidf", "metadata")]
        return [("words", "bayes", False), *logistic]
    return [(options.plan, options.mode, False)]


@dataclass(frozen=True)
class Report:
    """What one run of an experiment tells, a frame each; every arm is fitted once.

    metrics: plan, mode, reg_param, metric, value. distribution: plan, mode,
    bucket, low, high, comments, share of the labels the arm's plan makes.
    weights: plan, mode, bucket, side, slot, feature, weight; no rows for
    models without weights. counts: one row, loaded, filtered, limited, train, test.
    """

    metrics: DataFrame
    distribution: DataFrame
    weights: DataFrame
    counts: DataFrame


def report_experiment(comments: DataFrame, options: Options = Options(), **changes) -> Report:
    options = replace(options, **changes)
    counts = RowCounts.new()
    rows = prepare_rows(comments, options, counts)
    prepared: dict[tuple[str, bool], Prepared] = {}
    metrics, weights, shares = [], [], []
    for kind, mode, binary in _arms(options):
        if (kind, binary) not in prepared:
            prepared[kind, binary] = prepare(rows, kind, binary, options)
        data = prepared[kind, binary]
        arm = fit_arm(data, mode, options)
        metrics += [(kind, mode, float(reg), metric, value) for reg, metric, value in arm.metrics]
        weights += [(kind, mode, *row) for row in _weights(data, arm.model)]
        classes = class_distribution(data.featured)
        shares.append(classes.select(F.lit(kind).alias("plan"), F.lit(mode).alias("mode"), "*"))
    spark = comments.sparkSession
    return Report(
        spark.createDataFrame(metrics, METRICS),
        reduce(DataFrame.unionByName, shares),
        spark.createDataFrame(weights, WEIGHTS),
        counts.frame(spark),
    )


def run_experiment(comments: DataFrame, options: Options = Options(), **changes) -> DataFrame:
    """Metric rows `(plan, mode, reg_param, metric, value)`, one set per arm.

    A test metric is null where no row fell into the test part.
    """
    return report_experiment(comments, options, **changes).metrics


def explain_experiment(comments: DataFrame, options: Options = Options(), **changes) -> DataFrame:
    """Highest and lowest weights of every arm."""
    return report_experiment(comments, options, **changes).weights


def linear_per_community(
    comments: DataFrame, lexicon: DataFrame, reg_param: float = 0.0, by: str = "subreddit"
) -> DataFrame:
    """Linear regression on metadata for every community at once: (by, reg_param, metric, value).

    Metadata needs no fit, so one pass sums the products of the features per
    community, a grouped step solves each community's small system, and a
    second pass measures all of them. As many jobs for any number of
    communities, and none of their names reaches the driver. The penalty means
    what Spark's does. Metrics of a part without rows are null.
    """
    options = Options(plan="metadata", lexicon=lexicon)
    rows = prepare_rows(comments, options)
    plan = feature_plan("metadata", lexicon=lexicon, tokenized=True)
    features = vector_to_array("features").alias("x")
    data = FittedFeatures(plan.fit(rows)).transform(rows).select(by, "part", F.col("score_double").alias("y"), features)
    data = settle(data, "community-features")
    solved = solve_by_group(data.where(F.col("part") == TRAIN), [by], reg_param)
    predicted = data.join(solved, by, "left").withColumn(
        "error", F.pow(F.col("y") - F.col("intercept") - F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 2)
    )
    rmse = lambda part: F.sqrt(F.avg(F.when(F.col("part") == part, F.col("error"))))
    errors = predicted.groupBy(by).agg(rmse(TRAIN).alias("train_rmse"), rmse(TEST).alias("test_rmse"))
    metric = lambda name: F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))
    return errors.select(
        by, F.lit(float(reg_param)).alias("reg_param"), F.inline(F.array(metric("train_rmse"), metric("test_rmse")))
    )


def bayes_rows(comments: DataFrame, by: Sequence[str] = (), remove_stop_words: bool = True) -> DataFrame:
    """Rows for closed-form naive Bayes: id, by, part, binary label, words."""
    scored = with_binary_label(with_score(keep_real_comments(comments)), by=by, output="label")
    tokens = CommentTokenizer().transform(hash_split(scored))
    if remove_stop_words:
        tokens = StopWordsRemover(inputCol="words", outputCol="filtered").transform(tokens)
        tokens = tokens.drop("words").withColumnRenamed("filtered", "words")
    return tokens.select("id", *by, "part", "label", "words")


def logistic_rows(comments: DataFrame, by: str = "subreddit", vocabulary: int = WORDS_ONLY_VOCABULARY) -> DataFrame:
    """Rows for a logistic fit per community: id, by, part, label (above the community's quartile), entries of (slot, value).

    The words plan with one vocabulary for all communities.
    """
    rows = settle(bayes_rows(comments, [by]), "bayes-rows")
    bag = VocabularyCounter(inputCol="words", outputCol="bag", vocabSize=vocabulary).fit(rows)
    return settle(bag.transform(rows).select("id", by, "part", "label", nonzero_slots("bag").alias("entries")), "logistic-rows")


def logistic_per_community(
    comments: DataFrame, reg_param: float = 0.0, by: str = "subreddit", vocabulary: int = WORDS_ONLY_VOCABULARY
) -> DataFrame:
    """Logistic test accuracy of every community, all fitted in the same jobs: (by, rows, accuracy)."""
    rows = logistic_rows(comments, by, vocabulary)
    fitted = logistic.fit_groups(train_part(rows).select(by, F.col("label").alias("y"), "entries"), [by], reg_param)
    judged = logistic.margins_by_group(test_part(rows), fitted, [by], ["label"])
    judged = judged.select(by, "label", (F.col("margin") > 0).cast("double").alias("prediction"))
    return accuracy(judged, "label", [by])


def bin_class_per_community(comments: DataFrame, reg_param: float = 0.0, by: str = "subreddit") -> DataFrame:
    """Naive Bayes and logistic regression side by side for every community: (by, mode, metric, value).

    The comparison that `plan="bin_class"` makes over the whole table, each
    community around its own quartile. As many jobs for any number of
    communities. A community without test rows has no accuracy row.
    """
    labelled = with_binary_label(with_score(keep_real_comments(comments)), by=[by], output="label")
    above = F.count_if(F.col("label") == 1.0) / F.count("*")
    majority = labelled.groupBy(by).agg(F.greatest(above, 1 - above).alias("value"))
    arms = [("binary", bayes_per_community(comments, by)), ("logistic", logistic_per_community(comments, reg_param, by))]
    rows = [
        found.select(by, F.lit(mode).alias("mode"), F.lit("test_accuracy").alias("metric"), F.col("accuracy").alias("value"))
        for mode, found in arms
    ]
    rows += [majority.select(by, F.lit(mode).alias("mode"), F.lit("majority_share").alias("metric"), "value") for mode, _ in arms]
    return reduce(DataFrame.unionByName, rows)


def bayes_per_community(comments: DataFrame, community: str = "subreddit") -> DataFrame:
    """Naive Bayes test accuracy of every community, from one fit over all of them."""
    by = [community]
    rows = settle(bayes_rows(comments, by), "bayes-rows")
    return accuracy(bayes.predict(rows, bayes.fit(rows, by=by), by=by), "label", by)

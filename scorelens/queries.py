"""The registered queries: one operator or composition each, over whole tables.

Each takes the session and the folder of the tables. What a query fits or
settles runs when the query is built; the rest is lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, IDF, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions import scores, text
from scorelens.functions.vectors import nonzero_slots
from scorelens.operators import bayes, counts, evaluate, explain, lexicon, logistic, quantile, splits, vocabulary
from scorelens.operators.filters import first_rows, keep_real_comments, one_community
from scorelens.operators.labels import with_binary_label, with_log_bucket, with_score
from scorelens.operators.pca import principal_components
from scorelens.plans import models
from scorelens.plans.experiments import (
    bayes_per_community,
    bayes_rows,
    bin_class_per_community,
    explain_experiment,
    linear_per_community,
    logistic_rows,
    report_experiment,
    run_experiment,
)
from scorelens.plans.features import DEFAULT_BUCKETS, WORDS_ONLY_VOCABULARY, feature_plan, fit_features
from scorelens.plans.stages import (
    CommentTokenizer,
    VocabularyCounter,
    with_comment_features,
    with_record_features,
)
from scorelens.session import fresh_path, settle
from scorelens.sources import readers, writers
from scorelens.sources.tables import SMALL_LEXICON, comments

COMMENT = ["id", "body", "author", "subreddit", "created_utc", "score"]
SOME_COMMUNITIES = [f"src{i}" for i in range(10)]
ROW_CAP = 250
TOP_SCORES = 5
VOCABULARY = DEFAULT_BUCKETS
HASH_BUCKETS = DEFAULT_BUCKETS
LARGE_LEXICON = 25_000
COMPONENTS = 10
LINEAR_FEATURES = ("words_count", "link_count")
COMMUNITY_REG = 0.125
BUCKET_REGS = (0.125, 1.0)
# The sums of residuals that a settled fit may leave, as shares of the rows.
SETTLED = 1e-5


# Inputs shared by the queries


def _real(spark: SparkSession, sf: str) -> DataFrame:
    return keep_real_comments(comments(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_score(_real(spark, sf))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return CommentTokenizer().transform(_real(spark, sf)).select("id", "words")


def _content_words(spark: SparkSession, sf: str) -> DataFrame:
    stop = StopWordsRemover(inputCol="words", outputCol="filtered")
    return stop.transform(_words(spark, sf)).select("id", F.col("filtered").alias("words"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return readers.lexicon_frame(spark, SMALL_LEXICON)


def _joined(column: str) -> list:
    return ["id", F.size(column).alias("n"), F.array_join(column, "|").alias("words")]


# Sources and sinks


def warehouse_comments(spark, sf):
    return readers.as_comment_table(comments(spark, sf))


def json_comments(spark, sf):
    path = fresh_path(spark, "json")
    comments(spark, sf).write.json(path)
    return readers.read_json_comments(spark, path).select(COMMENT)


def csv_comments(spark, sf):
    path = fresh_path(spark, "csv")
    comments(spark, sf).write.csv(
        path,
        header=True,
        quoteAll=True,
        escape='"',
        lineSep="\n",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return readers.read_csv_comments(spark, path).select(COMMENT)


def lexicon_hits(spark, sf):
    return lexicon.lexicon_hits(_words(spark, sf), _lexicon(spark))


def lexicon_file_hits(spark, sf):
    """The lexicon comes from a file with remarks, lines of other widths, bad numbers and repeats."""
    folder = fresh_path(spark, "lexicon-file")
    first = ["# a remark", "one field", "best\t9", "haha\tmany", "three\tfields\t1"]
    lines = first + [f"{word}\t{valence}" for word, valence in SMALL_LEXICON.items()]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(folder)
    return lexicon.lexicon_hits(_words(spark, sf), readers.read_lexicon(spark, folder))


def sentiment_large_lexicon(spark, sf):
    """A lexicon of the table's own words, tens of thousands of them; valences follow from the word's length."""
    words = _words(spark, sf)
    uses = settle(vocabulary.term_uses(words), "term-uses")
    entries = vocabulary.top_terms(uses, LARGE_LEXICON).select(
        F.col("term").alias("word"), (F.length("term") % 7 - 3).cast("int").alias("valence")
    )
    return lexicon.with_sentiment(words, entries).select("id", F.round("sentiment", 9).alias("sentiment"))


def community_tables(spark, sf):
    path = fresh_path(spark, "communities")
    writers.write_community_tables(comments(spark, sf), path, SOME_COMMUNITIES)
    return (
        spark.read.parquet(path)
        .groupBy(F.col("month").cast("string").alias("month"), "subreddit")
        .agg(F.count("*").alias("comments"), F.sum(F.length("body")).alias("chars"))
    )


# Filters, limits, sorts, counts


def filter_placeholders(spark, sf):
    return _real(spark, sf).select("id", "author", "body")


def community_comments(spark, sf):
    return one_community(_real(spark, sf), "src3").select("id", "score")


def row_cap(spark, sf):
    return first_rows(_real(spark, sf), ROW_CAP).select("id", "score")


def subreddit_counts(spark, sf):
    return counts.community_counts(_real(spark, sf))


def stage_counts(spark, sf):
    return counts.stage_counts(comments(spark, sf), ROW_CAP)


def score_cast(spark, sf):
    return _real(spark, sf).select("id", scores.score_double(F.col("score")).alias("score_double"))


def top_scores(spark, sf):
    return counts.top_scores(_real(spark, sf), TOP_SCORES)


def score_summary(spark, sf):
    return counts.score_summary(_real(spark, sf))


# Text


def tokens_raw(spark, sf):
    tokens = _real(spark, sf).select("id", text.raw_tokens(F.col("body")).alias("raw"))
    return tokens.select(*_joined("raw"))


def tokens_clean(spark, sf):
    return _words(spark, sf).select(*_joined("words"))


def stopword_filter(spark, sf):
    return _content_words(spark, sf).select(*_joined("words"))


def lexicon_filter(spark, sf):
    return lexicon.with_lexicon_words(settle(_words(spark, sf), "tokenized"), _lexicon(spark)).select(*_joined("filtered"))


def lexicon_filter_by_join(spark, sf):
    kept = lexicon.with_lexicon_words(settle(_words(spark, sf), "tokenized"), _lexicon(spark))
    return kept.select(*_joined("filtered"))


def metadata_features(spark, sf):
    words = settle(CommentTokenizer().transform(_real(spark, sf)), "tokenized")
    return with_comment_features(words, _lexicon(spark)).drop(*COMMENT[1:], "words")


def sentiment_by_join(spark, sf):
    return lexicon.with_sentiment(settle(_words(spark, sf), "tokenized"), _lexicon(spark)).select("id", "sentiment")


def run_sentiment(spark, sf):
    runs = settle(_real(spark, sf).select("id", text.word_runs(F.col("body")).alias("words")), "word-runs")
    return lexicon.with_sentiment(runs, _lexicon(spark), skip_zero=True).select("id", "sentiment")


def raw_text_stats(spark, sf):
    body = F.col("body")
    return _real(spark, sf).select(
        "id",
        F.length(body).alias("body_chars"),
        text.link_count(body).alias("link_count"),
        text.space_words_count(body).alias("space_words"),
        text.space_word_length(body).alias("space_word_length"),
    )


def record_features(spark, sf):
    return with_record_features(settle(_real(spark, sf), "comments"), _lexicon(spark)).drop(*COMMENT[1:], "words")


# Vectorisers and feature plans


def regex_bag(spark, sf):
    runs = _real(spark, sf).select("id", text.word_runs(F.col("body")).alias("words"))
    return vocabulary.term_frequencies(runs)


def vocabulary_topk(spark, sf):
    uses = settle(vocabulary.term_uses(_content_words(spark, sf)), "term-uses")
    return vocabulary.top_terms(uses, VOCABULARY)


def term_doc_freq(spark, sf):
    return vocabulary.document_frequency(_content_words(spark, sf))


def idf_weights(spark, sf):
    weights = vocabulary.idf_weights(_words(spark, sf))
    return weights.withColumn("idf", F.round("idf", 9))


def tfidf_terms(spark, sf):
    return vocabulary.tfidf_terms(_words(spark, sf)).withColumn("tfidf", F.round("tfidf", 9))


def bag_of_words(spark, sf):
    words = _content_words(spark, sf)
    model = VocabularyCounter(inputCol="words", outputCol="bag", vocabSize=VOCABULARY).fit(words)
    return _slots(model.transform(words), "bag")


def _slots(df: DataFrame, vector: str) -> DataFrame:
    rows = df.select("id", F.inline(nonzero_slots(vector)))
    return rows.select("id", "slot", F.round("value", 9).alias("value"))


def _hashed(spark, sf) -> DataFrame:
    return HashingTF(inputCol="words", outputCol="tf", numFeatures=HASH_BUCKETS).transform(_words(spark, sf))


def hashing_tf(spark, sf):
    return _slots(_hashed(spark, sf), "tf")


def hashed_tfidf(spark, sf):
    hashed = _hashed(spark, sf)
    return _slots(IDF(inputCol="tf", outputCol="tfidf").fit(hashed).transform(hashed), "tfidf")


def _plan_slots(kind: str, vector: str = "features", buckets: int | None = DEFAULT_BUCKETS):
    def query(spark, sf):
        rows = settle(CommentTokenizer().transform(_real(spark, sf)), "tokenized")
        plan = feature_plan(kind, buckets=buckets, lexicon=_lexicon(spark), tokenized=True)
        return _slots(fit_features(rows, plan).narrow(rows, "id", vector), vector)

    return query


def features_pca(spark, sf):
    rows = settle(CommentTokenizer().transform(_real(spark, sf)), "tokenized")
    plan = feature_plan("pca", buckets=COMPONENTS, lexicon=_lexicon(spark), tokenized=True)
    return _slots(fit_features(rows, plan).transform(rows), "features")


def features_reloaded(spark, sf):
    """The metadata plan, fitted, saved, loaded and applied."""
    rows = settle(CommentTokenizer().transform(_real(spark, sf)), "tokenized")
    fitted = fit_features(rows, feature_plan("metadata", lexicon=_lexicon(spark), tokenized=True))
    path = fresh_path(spark, "plan")
    fitted.model.write().save(path)
    return _slots(PipelineModel.load(path).transform(rows), "features")


# Labels and distributions


def quartile_threshold(spark, sf):
    return quantile.upper_quartile(_scored(spark, sf))


def quartile_by_community(spark, sf):
    return quantile.upper_quartile(_scored(spark, sf), by=["subreddit"])


def binary_label(spark, sf):
    return with_binary_label(_scored(spark, sf)).select("id", "score_double", "score_bucket")


def log_bucket(spark, sf):
    return with_log_bucket(_scored(spark, sf)).select("id", "score_double", "score_bucket")


def binary_distribution(spark, sf):
    scored = _scored(spark, sf)
    threshold = quantile.upper_quartile(scored).first()["threshold"]
    return counts.binary_distribution(scored, threshold)


def bucket_distribution(spark, sf):
    return counts.class_distribution(with_log_bucket(_scored(spark, sf)))


def majority_baseline(spark, sf):
    return counts.majority_baseline(with_binary_label(_scored(spark, sf)))


def binary_distribution_by_community(spark, sf):
    """Class shares of every community around its own upper quartile."""
    labelled = with_binary_label(_scored(spark, sf), by=["subreddit"])
    above = F.count_if(F.col("score_bucket") == 1.0)
    return labelled.groupBy("subreddit").agg(
        F.count("*").alias("comments"),
        F.max("threshold").alias("threshold"),
        above.alias("above"),
        (above.cast("double") / F.count("*")).alias("above_share"),
    )


# Splits


def hash_split(spark, sf):
    return splits.hash_split(_real(spark, sf)).select("id", "part")


def tuning_split(spark, sf):
    train = splits.train_part(splits.hash_split(_real(spark, sf)))
    return splits.hash_split(train, splits.TUNING_PERCENT, salt="tuning-").select("id", "part")


def ordered_split(spark, sf):
    return splits.ordered_split(_real(spark, sf)).select("id", "part")


def ordered_split_text(spark, sf):
    """The positional split over the text ids that the JSON and CSV readers give."""
    rows = _real(spark, sf).withColumn("id", F.concat(F.lit("t1_"), F.conv(F.col("id").cast("string"), 10, 36)))
    return splits.ordered_split(rows).select("id", "part")


def row_cap_repeated(spark, sf):
    """The row cap over a key that many rows share: exactly so many rows, from as few keys as can be."""
    rows = first_rows(_real(spark, sf), ROW_CAP, key="subreddit")
    return rows.groupBy("subreddit").agg(F.count("*").alias("comments"))


def random_split(spark, sf):
    return splits.random_split(_real(spark, sf).select("id", "score"))


# Naive Bayes in closed form


def _bayes(spark, sf):
    rows = settle(bayes_rows(comments(spark, sf)), "bayes-rows")
    return rows, bayes.fit(rows)


def nb_priors(spark, sf):
    rows = with_binary_label(splits.hash_split(_scored(spark, sf)), output="label")
    return bayes.class_priors(rows).withColumn("log_prior", F.round("log_prior", 9))


def nb_theta(spark, sf):
    _, likelihoods = _bayes(spark, sf)
    return bayes.theta(likelihoods).withColumn("log_prob", F.round("log_prob", 9))


def nb_predictions(spark, sf):
    rows, likelihoods = _bayes(spark, sf)
    return bayes.predict(rows, likelihoods)


def nb_accuracy(spark, sf):
    rows, likelihoods = _bayes(spark, sf)
    return evaluate.accuracy(bayes.predict(rows, likelihoods), "label")


def nb_bucket_accuracy(spark, sf):
    """All log buckets instead of two classes."""
    rows = bayes_rows(comments(spark, sf)).drop("label")
    buckets = with_log_bucket(_scored(spark, sf), "label").select("id", "label")
    rows = settle(rows.join(buckets, "id"), "bayes-buckets")
    classes = bayes.classes_of(rows)
    likelihoods = bayes.fit(rows, classes)
    return evaluate.accuracy(bayes.predict(rows, likelihoods, classes), "label")


def nb_top_terms(spark, sf):
    _, likelihoods = _bayes(spark, sf)
    return bayes.top_terms_of_class(likelihoods, explain.TOP).withColumn("weight", F.round("weight", 9))


def nb_by_community(spark, sf):
    return bayes_per_community(comments(spark, sf))


# Regression


def _linear_frame(spark, sf, features=LINEAR_FEATURES) -> DataFrame:
    words = CommentTokenizer().transform(splits.hash_split(_scored(spark, sf)))
    body = F.col("body")
    rows = words.select(
        "id",
        "part",
        "body",
        F.array_join("words", "|").alias("words"),
        "score_double",
        text.words_count(F.col("words")).alias("words_count"),
        text.link_count(body).alias("link_count"),
    )
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return settle(rows, "linear")


def _parts(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    return splits.train_part(frame), splits.test_part(frame)


def linear_errors(spark, sf):
    """Mean squared and root mean squared test error of two-feature least squares."""
    train, test = _parts(_linear_frame(spark, sf))
    errors = evaluate.regression_errors(models.fit_linear(train).transform(test))
    return errors.select("rows", F.round("mse", 6).alias("mse"), F.round("rmse", 6).alias("rmse"))


def sgd_errors(spark, sf):
    """Gradient steps over all rows, until they are at the least squares."""
    train, test = _parts(_linear_frame(spark, sf))
    errors = evaluate.regression_errors(models.fit_sgd(train, steps=60).transform(test))
    return errors.select("rows", F.round("rmse", 4).alias("rmse"))


def sgd_three_steps(spark, sf):
    """Weights after three steps on batches of half of the rows."""
    train, _ = _parts(_linear_frame(spark, sf))
    model = models.fit_sgd(train, steps=3, step_size=0.5, batch_percent=50)
    rows = [(float(model.intercept), *map(float, model.coefficients))]
    found = spark.createDataFrame(rows, "intercept double, words_count double, link_count double")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


def linear_weights(spark, sf):
    train, _ = _parts(_linear_frame(spark, sf))
    model = models.fit_linear(train)
    weights = explain.explain_weights(spark, model.coefficients.toArray(), LINEAR_FEATURES, 1)
    return weights.withColumn("weight", F.round("weight", 6))


def reg_path_one_feature(spark, sf):
    path = models.regularisation_path(_linear_frame(spark, sf, LINEAR_FEATURES[:1]))
    curve = spark.createDataFrame(path, "reg_param double, train_rmse double, test_rmse double")
    written = fresh_path(spark, "curve")
    writers.write_curve(curve, written)
    stored = spark.read.schema(curve.schema).csv(written)
    return stored.select(
        "reg_param",
        F.round("train_rmse", 6).alias("train_rmse"),
        F.round("test_rmse", 6).alias("test_rmse"),
    )


def ridge_one_feature(spark, sf):
    """Validation error of every penalty, and the error of the chosen one, fitted on all training rows."""
    train, test = _parts(_linear_frame(spark, sf, LINEAR_FEATURES[:1]))
    tuned = models.fit_ridge(train)
    error = models.rmse(tuned.model, test)
    rows = [(reg, metric, reg == tuned.reg_param, error) for reg, metric in zip(models.REG_GRID, tuned.metrics)]
    found = spark.createDataFrame(rows, "reg_param double, tuning_rmse double, chosen boolean, test_rmse double")
    return found.select(
        "reg_param",
        F.round("tuning_rmse", 6).alias("tuning_rmse"),
        "chosen",
        F.when(F.col("chosen"), F.round("test_rmse", 6)).alias("test_rmse"),
    )


def pca_two_features(spark, sf):
    """Both components of two features: share of the variance and loadings."""
    frame = _linear_frame(spark, sf)
    loadings, shares = principal_components(frame, "features", 2, 2)
    rows = [(i + 1, float(shares[i]), *map(float, loadings[:, i])) for i in range(2)]
    found = spark.createDataFrame(rows, "component int, share double, words_count double, link_count double")
    return found.select("component", *(F.round(c, 8).alias(c) for c in found.columns[1:]))


def ridge_path_metadata(spark, sf):
    """For every penalty on the metadata: training rows, and whether each feature's residuals meet the penalty's pull."""
    rows = settle(CommentTokenizer().transform(splits.hash_split(_scored(spark, sf))), "tokenized")
    plan = feature_plan("metadata", lexicon=_lexicon(spark), tokenized=True)
    train = splits.train_part(settle(fit_features(rows, plan).featured(rows, "part"), "path-rows"))
    width = models.vector_width(train)
    data = train.select("score_double", vector_to_array("features").alias("x"))
    moments = data.agg(F.count("*"), F.stddev_pop("score_double"), *(F.var_pop(F.col("x")[j]) for j in range(width))).first()
    n, sd, variance = moments[0], moments[1], moments[2:]
    out = []
    for reg, model in zip(models.REG_GRID, models.fit_linear_path(train, models.REG_GRID)):
        w = model.coefficients.toArray()
        miss = F.col("prediction") - F.col("score_double")
        x = vector_to_array("features")
        # Residuals per feature, in its own spread, against what the penalty takes off its slope.
        lefts = [F.abs(F.sum(miss) / n)] + [
            F.abs(F.sum(miss * x[j]) / n + reg / sd * v * float(w[j])) / v**0.5 if v > 1e-12 else F.lit(abs(float(w[j])))
            for j, v in enumerate(variance)
        ]
        settled = (F.greatest(*lefts) < SETTLED * sd).alias("settled")
        out.append(model.transform(train).agg(F.lit(reg).alias("reg_param"), F.count("*").alias("rows"), settled))
    return reduce(DataFrame.unionByName, out)


def tree_on_hour(spark, sf):
    """What a forest of one tree with one split on the hour predicts for every hour."""
    rows = splits.hash_split(_scored(spark, sf)).select("part", "score_double", text.hour_of_day(F.col("created_utc")).alias("hour"))
    rows = settle(VectorAssembler(inputCols=["hour"], outputCol="features").transform(rows), "hours")
    model = models.fit_forest(splits.train_part(rows), numTrees=1, maxDepth=1, bootstrap=False)
    predicted = model.transform(rows).groupBy("hour").agg(F.count("*").alias("rows"), F.max("prediction").alias("prediction"))
    return predicted.withColumn("prediction", F.round("prediction", 6))


def prediction_sample(spark, sf):
    train, test = _parts(_linear_frame(spark, sf))
    sample = evaluate.prediction_sample(models.fit_linear(train).transform(test))
    return sample.withColumns(
        {"prediction": F.round("prediction", 6), "sq_err": F.round("sq_err", 4)}
    )


def last_predictions(spark, sf):
    train, test = _parts(_linear_frame(spark, sf))
    last = evaluate.last_predictions(models.fit_linear(train).transform(test))
    return last.withColumn("prediction", F.round("prediction", 6))


# Multi-fit jobs


def _experiment(**options):
    def query(spark, sf):
        return run_experiment(comments(spark, sf), lexicon=_lexicon(spark), **options)

    return query


def _rounded(query):
    return lambda spark, sf: query(spark, sf).withColumn("value", F.round("value", 9))


def run_counts(spark, sf):
    """Rows at each stage of one run, as its own jobs saw them."""
    options = {"plan": "metadata", "mode": "linear", "limit": ROW_CAP, "lexicon": _lexicon(spark)}
    return report_experiment(comments(spark, sf), **options).counts


def experiment_per_community(spark, sf):
    """Linear regression on metadata for every community of the table, all in the same jobs."""
    return linear_per_community(comments(spark, sf), _lexicon(spark), reg_param=8.0)


def logistic_weights(spark, sf):
    """Highest and lowest weights of every bucket's fit."""
    view = comments(spark, sf)
    return explain_experiment(view, plan="metadata", mode="logistic", reg_param=0.125, lexicon=_lexicon(spark))


def logistic_one_feature_by_community(spark, sf):
    """Every community's own logistic fit on the number of words, all in the same jobs."""
    labelled = with_binary_label(splits.hash_split(_scored(spark, sf)), by=["subreddit"], output="y")
    words = CommentTokenizer().transform(splits.train_part(labelled))
    entry = F.struct(F.lit(0).alias("slot"), text.words_count(F.col("words")).cast("double").alias("value"))
    rows = settle(words.select("subreddit", "y", F.array(entry).alias("entries")), "one-feature")
    fitted = logistic.fit_groups(rows, ["subreddit"], COMMUNITY_REG, tolerance=1e-9)
    sizes = rows.groupBy("subreddit").agg(F.count("*").alias("rows"))
    weight = F.coalesce(F.get("weights", F.lit(0)), F.lit(0.0))
    return fitted.join(sizes, "subreddit").select(
        "subreddit", "rows", F.round("intercept", 5).alias("intercept"), F.round(weight, 6).alias("weight")
    )


def logistic_by_community(spark, sf):
    """The words of every community's comments: where its fit is settled, each word's residuals meet the penalty's pull.

    Residuals and pulls are summed here from the rows and the weights alone.
    """
    by = ["subreddit"]
    rows = splits.train_part(logistic_rows(comments(spark, sf))).withColumnRenamed("label", "y")
    fitted = logistic.fit_groups(rows, by, COMMUNITY_REG)
    judged = settle(logistic.margins_by_group(rows, fitted, by, ["id", "y"]), "judged")
    residuals = judged.select("subreddit", "id", (1 / (1 + F.exp(-F.col("margin"))) - F.col("y")).alias("residual"))
    sizes = residuals.groupBy(by).agg(F.count("*").alias("rows"), F.sum("residual").alias("residuals"))
    slot = (
        rows.select("subreddit", "id", F.inline("entries"))
        .join(residuals, ["subreddit", "id"])
        .groupBy("subreddit", "slot")
        .agg(F.sum(F.col("value") * F.col("residual")).alias("against"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    )
    weights = fitted.select("subreddit", F.inline(F.arrays_zip(F.col("known").alias("slot"), F.col("weights").alias("weight"))))
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("rows")) / (F.col("rows") - 1)
    # Of features without variance nothing is asked, they weigh nothing.
    left = F.when(
        variance > 1e-12, F.abs(F.col("against") / F.col("rows") + COMMUNITY_REG * variance * F.col("weight")) / F.sqrt(variance)
    ).otherwise(F.abs("weight"))
    checked = slot.join(weights, ["subreddit", "slot"]).join(sizes, "subreddit").groupBy("subreddit").agg(
        F.count("*").alias("terms"), F.max(left).alias("worst")
    )
    return sizes.join(checked, "subreddit", "left").select(
        "subreddit",
        "rows",
        F.coalesce("terms", F.lit(0)).alias("terms"),
        (F.greatest(F.coalesce("worst", F.lit(0.0)), F.abs(F.col("residuals") / F.col("rows"))) < SETTLED).alias("settled"),
    )


def bin_class_by_community(spark, sf):
    """Naive Bayes against logistic regression for every community."""
    found = bin_class_per_community(comments(spark, sf), COMMUNITY_REG)
    return found.withColumn("value", F.round("value", 9))


def _bucket_rows(spark, sf, plan: str) -> DataFrame:
    rows = settle(CommentTokenizer().transform(splits.hash_split(_scored(spark, sf))), "tokenized")
    fitted = fit_features(rows, feature_plan(plan, lexicon=_lexicon(spark), tokenized=True))
    return settle(splits.train_part(fitted.featured(rows, "part")), "bucket-rows")


def bucket_logistic_one_feature(spark, sf):
    """One-vs-rest weights of every bucket and penalty, from the same passes."""
    train, _ = _parts(_linear_frame(spark, sf, LINEAR_FEATURES[:1]))
    path = models.fit_logistic_path(with_log_bucket(train), BUCKET_REGS)
    rows = [
        (bucket, reg, model.intercepts[bucket], float(weights[0]))
        for reg, model in zip(BUCKET_REGS, path)
        for bucket, weights in model.weights.items()
    ]
    found = spark.createDataFrame(rows, "bucket double, reg_param double, intercept double, weight double")
    return found.withColumns({"intercept": F.round("intercept", 5), "weight": F.round("weight", 6)})


def bucket_logistic_metadata(spark, sf):
    """For every bucket and penalty on the metadata: its rows, and whether residual sums per feature meet the penalty's pull."""
    train = _bucket_rows(spark, sf, "metadata")
    path = models.fit_logistic_path(train, BUCKET_REGS)
    values = vector_to_array("features")
    rows = train.select("score_bucket", values.alias("x"))
    width = models.vector_width(train)
    moments = rows.agg(
        F.count("*"),
        *(F.var_samp(F.col("x")[j]) for j in range(width)),
    ).first()
    n, variance = moments[0], list(moments[1:])
    out = None
    for reg, model in zip(BUCKET_REGS, path):
        for bucket, weights in model.weights.items():
            margin = F.aggregate(
                F.zip_with("x", F.array(*map(F.lit, weights.tolist())), lambda a, b: a * b), F.lit(model.intercepts[bucket]), lambda s, v: s + v
            )
            member = (F.col("score_bucket") == bucket).cast("double")
            residual = 1 / (1 + F.exp(-margin)) - member
            lefts = [F.abs(F.sum("r")) / n] + [
                F.abs(F.sum(F.col("r") * F.col("x")[j]) / n + reg * v * float(w)) / v**0.5 if v and v > 1e-12 else F.lit(abs(float(w)))
                for j, (v, w) in enumerate(zip(variance, weights))
            ]
            row = rows.select("x", residual.alias("r"), member.alias("member")).agg(
                F.lit(bucket).alias("bucket"),
                F.lit(reg).alias("reg_param"),
                F.sum("member").cast("bigint").alias("members"),
                (F.greatest(*lefts) < SETTLED).alias("settled"),
            )
            out = row if out is None else out.unionByName(row)
    return out


def logistic_tuned(spark, sf):
    rows = settle(CommentTokenizer().transform(splits.hash_split(_scored(spark, sf))), "tokenized")
    plan = feature_plan("metadata", lexicon=_lexicon(spark), tokenized=True, binary=True)
    fitted = fit_features(rows, plan)
    train, test = _parts(settle(fitted.featured(rows, "part"), "tuned"))
    tuned = models.tune_logistic(train)
    return evaluate.accuracy(tuned.model.transform(test)).withColumn("reg_param", F.lit(tuned.reg_param))


ALL = {
    query.__name__: query
    for query in (
        warehouse_comments,
        json_comments,
        csv_comments,
        lexicon_hits,
        lexicon_file_hits,
        sentiment_large_lexicon,
        community_tables,
        filter_placeholders,
        community_comments,
        row_cap,
        subreddit_counts,
        stage_counts,
        score_cast,
        top_scores,
        score_summary,
        tokens_raw,
        tokens_clean,
        stopword_filter,
        lexicon_filter,
        lexicon_filter_by_join,
        metadata_features,
        sentiment_by_join,
        run_sentiment,
        raw_text_stats,
        record_features,
        regex_bag,
        vocabulary_topk,
        term_doc_freq,
        idf_weights,
        tfidf_terms,
        bag_of_words,
        hashing_tf,
        hashed_tfidf,
        features_pca,
        features_reloaded,
        tree_on_hour,
        quartile_threshold,
        quartile_by_community,
        binary_label,
        log_bucket,
        binary_distribution,
        bucket_distribution,
        majority_baseline,
        binary_distribution_by_community,
        hash_split,
        tuning_split,
        ordered_split,
        ordered_split_text,
        row_cap_repeated,
        random_split,
        nb_priors,
        nb_theta,
        nb_predictions,
        nb_accuracy,
        nb_bucket_accuracy,
        nb_top_terms,
        nb_by_community,
        linear_errors,
        sgd_errors,
        sgd_three_steps,
        linear_weights,
        reg_path_one_feature,
        ridge_one_feature,
        pca_two_features,
        ridge_path_metadata,
        prediction_sample,
        last_predictions,
        run_counts,
        experiment_per_community,
        logistic_weights,
        logistic_tuned,
        logistic_one_feature_by_community,
        logistic_by_community,
        bin_class_by_community,
        bucket_logistic_one_feature,
        bucket_logistic_metadata,
    )
} | {
    "hour_one_hot": _plan_slots("metadata", "hour_encoded"),
    "features_bag": _plan_slots("bag"),
    "features_sentiment": _plan_slots("sentiment", buckets=WORDS_ONLY_VOCABULARY),
    "features_metadata": _plan_slots("metadata"),
    "features_tfidf": _plan_slots("tfidf", buckets=HASH_BUCKETS),
    "features_words": _plan_slots("words"),
    "features_record": _plan_slots("record", buckets=None),
    "linear_record": _experiment(plan="record", mode="linear", buckets=None, reg_param=8.0, split="ordered"),
    "linear_bag": _experiment(plan="bag", mode="linear", reg_param=8.0),
    "ridge_bag": _experiment(plan="bag", mode="ridge"),
    "ridge_metadata": _experiment(plan="metadata", mode="ridge"),
    "reg_path_bag": _experiment(plan="bag", mode="reg"),
    "forest_metadata": _experiment(plan="metadata", mode="forest"),
    "sgd_metadata": _experiment(plan="metadata", mode="sgd"),
    "linear_pca": _experiment(plan="pca", mode="linear", buckets=COMPONENTS),
    "experiment_binary": _rounded(_experiment(mode="binary")),
    "experiment_bayes": _rounded(_experiment(mode="bayes")),
    "experiment_all": _experiment(plan="all", mode="linear", reg_param=8.0),
    "experiment_bin_class": _experiment(plan="bin_class", reg_param=0.125),
    "experiment_multi_class": _experiment(plan="multi_class", reg_param=1.0),
}

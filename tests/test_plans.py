import math
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, CountVectorizerModel, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scorelens.operators import bayes, evaluate, splits
from scorelens.operators.filters import keep_real_comments, one_community
from scorelens.operators.labels import with_score
from scorelens.operators.least_squares import solve_by_group
from scorelens.operators.lexicon import with_sentiment
from scorelens.plans import models
from scorelens.plans.experiments import (
    Options,
    bayes_rows,
    explain_experiment,
    linear_per_community,
    prepare,
    prepare_rows,
    report_experiment,
    run_experiment,
)
from scorelens.plans.features import PLANS, feature_plan, fit_features
from scorelens.plans.stages import CommentFeatures, CommentTokenizer, ScoreLabeler, TermPCA, VocabularyCounter
from scorelens.session import settle, write_once
from scorelens.sources.readers import lexicon_frame, read_json_comments
from scorelens.sources.tables import SMALL_LEXICON, comments

METADATA_WIDTH = 30


@pytest.fixture(scope="module")
def real(spark, sf):
    return keep_real_comments(comments(spark, sf)).cache()


@pytest.fixture(scope="module")
def lexicon(spark):
    return lexicon_frame(spark, SMALL_LEXICON)


@pytest.mark.parametrize("kind", PLANS)
def test_plan_width_and_names(real, lexicon, kind):
    plan = feature_plan(kind, buckets=20, lexicon=lexicon, pca_vocabulary=40)
    fitted = fit_features(real, plan)
    featured = fitted.featured(real).select(F.size(vector_to_array("features")).alias("width"))
    (width,) = {row["width"] for row in featured.collect()}
    words = {"bag": 20, "sentiment": len(fitted.vocabulary), "metadata": 0, "tfidf": 20, "pca": 20}
    if kind == "words":
        assert width == len(fitted.vocabulary)
    elif kind == "record":
        assert width == 20 + 5
    else:
        assert width == words[kind] + METADATA_WIDTH - (2 if kind == "sentiment" else 0)
    names = fitted.names(width)
    assert len(names) == width == len(set(names))
    assert bool(fitted.vocabulary) == (kind in ("bag", "sentiment", "words", "record"))


def test_feature_files_carry_no_slot_metadata(real, lexicon):
    fitted = fit_features(real, feature_plan("bag", buckets=20, lexicon=lexicon))
    assert fitted.featured(real).schema["features"].metadata == {}


def test_sentiment_plan_drops_rows(real, lexicon):
    fitted = fit_features(real, feature_plan("sentiment", buckets=20, lexicon=lexicon))
    assert 0 < fitted.transform(real).count() < real.count()


def test_fitted_plan_saves_and_loads(real, lexicon, tmp_path):
    plan = feature_plan("bag", buckets=15, lexicon=lexicon, binary=True)
    fitted = fit_features(real, plan)
    path = str(tmp_path / "model")
    fitted.model.save(path)
    again = PipelineModel.load(path)
    columns = ["id", "score_bucket", "features"]
    before = fitted.transform(real).select(columns).orderBy("id").collect()
    assert again.transform(real).select(columns).orderBy("id").collect() == before


def test_vocabulary_is_the_same_on_any_layout(spark, real):
    words = CommentTokenizer().transform(real)
    counter = VocabularyCounter(inputCol="words", vocabSize=50)
    first = counter.fit(words.repartition(3)).vocabulary
    assert first == counter.fit(words.repartition(11)).vocabulary


def test_labeler_needs_a_score(spark):
    empty = spark.createDataFrame([], "score_double double")
    with pytest.raises(ValueError):
        ScoreLabeler().fit(empty)
    model = ScoreLabeler(binary=True).fit(spark.createDataFrame([(float(i),) for i in range(1, 5)], "score_double double"))
    assert (model.getOrDefault(model.threshold), model.getOrDefault(model.maxScore)) == (3.0, 4.0)


def test_closed_form_bayes_equals_spark_ml(spark, sf):
    rows = bayes_rows(comments(spark, sf)).cache()
    likelihoods = bayes.fit(rows)
    counter = VocabularyCounter(inputCol="words", outputCol="features").fit(rows)
    vectors = counter.transform(rows).withColumnRenamed("label", "score_bucket")
    model = models.fit_naive_bayes(splits.train_part(vectors))
    slot = {term: i for i, term in enumerate(counter.vocabulary)}
    theta = model.theta.toArray()
    for row in bayes.theta(likelihoods).collect():
        assert math.isclose(row["log_prob"], theta[int(row["label"]), slot[row["term"]]], rel_tol=1e-12)
    priors = {row["label"]: row["log_prior"] for row in bayes.class_priors(rows).collect()}
    np.testing.assert_allclose([priors[0.0], priors[1.0]], model.pi.toArray(), rtol=1e-12)
    ml = {r["id"]: r["prediction"] for r in model.transform(splits.test_part(vectors)).collect()}
    ours = {r["id"]: r["prediction"] for r in bayes.predict(rows, likelihoods).collect()}
    assert ours == ml


def test_bayes_of_buckets_with_gaps(spark):
    rows = [(label, Vectors.dense(v)) for label, v in [(1.0, [9.0, 0, 0]), (4.0, [0, 9.0, 0]), (7.0, [0, 0, 9.0])] * 3]
    df = spark.createDataFrame(rows, ["score_bucket", "features"])
    got = models.fit_naive_bayes(df).transform(df).select("score_bucket", "prediction").distinct().collect()
    assert sorted(map(tuple, got)) == [(1.0, 1.0), (4.0, 4.0), (7.0, 7.0)]


def test_bayes_vocabulary_cap(spark, sf):
    rows = bayes_rows(comments(spark, sf), ["subreddit"]).cache()
    capped = bayes.fit(rows, by=["subreddit"], vocabulary=5)
    assert {row["count"] for row in capped.groupBy("subreddit").count().collect()} == {5}


def test_bayes_rows_without_known_terms_get_the_prior(spark):
    rows = spark.createDataFrame(
        [
            (1, "train", 0.0, ["a", "b"]),
            (2, "train", 0.0, ["a"]),
            (3, "train", 1.0, ["c"]),
            (4, "test", 1.0, []),
            (5, "test", 1.0, ["c", "c"]),
        ],
        "id int, part string, label double, words array<string>",
    )
    got = bayes.predict(rows, bayes.fit(rows)).orderBy("id").collect()
    assert [(row["id"], row["prediction"]) for row in got] == [(4, 0.0), (5, 1.0)]


def points(spark, n=60):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, 1.0]
    y = 4 + x @ [2.0, -1.0, 3.0] + draw.normal(size=n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double, score_double double")
    return x, y, VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(df)


@pytest.mark.parametrize("reg", [0.0, 0.5, 4.0])
def test_ridge_closed_form(spark, reg):
    """Spark shrinks the slopes of standardised features by reg / sd(score)."""
    x, y, df = points(spark)
    model = models.fit_linear(df, reg)
    sd = x.std(axis=0)
    z, c = (x - x.mean(axis=0)) / sd, y - y.mean()
    penalty = reg / y.std() * len(y) * np.eye(3)
    expected = np.linalg.solve(z.T @ z + penalty, z.T @ c) / sd
    np.testing.assert_allclose(model.coefficients.toArray(), expected, rtol=1e-8)


def test_components_are_those_of_the_covariance(spark):
    draw = np.random.default_rng(8)
    x = draw.poisson(0.4, size=(300, 25)) * draw.uniform(0.2, 4, 25)
    x[:20] = 0
    rows = [(i, Vectors.sparse(25, {int(j): float(r[j]) for j in np.flatnonzero(r)})) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "words_features"]).repartition(3)
    ours, theirs = TermPCA(k=4).fit(df), PCA(k=4, inputCol="words_features", outputCol="p").fit(df)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    np.testing.assert_allclose(ours.explainedVariance.toArray(), values[:4] / values.sum(), rtol=1e-6)
    np.testing.assert_allclose(ours.explainedVariance.toArray(), theirs.explainedVariance.toArray(), rtol=1e-6)
    a, b = ours.pc.toArray(), theirs.pc.toArray()
    np.testing.assert_allclose(np.abs((a * b).sum(axis=0)), 1, atol=1e-5)
    got = np.array([r["words_reduced"].toArray() for r in ours.transform(df).orderBy("id").collect()])
    np.testing.assert_allclose(got, x @ a, atol=1e-9)


def test_iterative_fit_reaches_least_squares(spark):
    _, _, df = points(spark)
    exact, steps = models.fit_linear(df), models.fit_sgd(df, steps=300)
    np.testing.assert_allclose(steps.coefficients.toArray(), exact.coefficients.toArray(), rtol=1e-3)


def test_regularisation_path_equals_single_fits(spark):
    _, _, df = points(spark)
    parts = splits.hash_split(df)
    train, test = splits.train_part(parts), splits.test_part(parts)
    for reg, fit, error in models.regularisation_path(parts, (0.0, 2.0)):
        model = models.fit_linear(train, reg)
        assert math.isclose(fit, models.rmse(model, train), rel_tol=1e-9)
        assert math.isclose(error, models.rmse(model, test), rel_tol=1e-9)


def test_ridge_search_picks_the_best_penalty(spark):
    _, _, df = points(spark)
    tuned = models.fit_ridge(df, (0.0, 50.0))
    assert tuned.reg_param == 0.0 and tuned.metrics[0] < tuned.metrics[1]


def bucket_rows(spark):
    """One indicator per group; class shares differ by group."""
    shares = {0: (8, 2, 0), 1: (1, 8, 1), 2: (1, 2, 7)}
    rows = [
        (float(g == 0), float(g == 1), float(label))
        for g, counts in shares.items()
        for label, n in enumerate(counts)
        for _ in range(n)
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, score_bucket double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_one_vs_rest_logistic_on_group_indicators(spark):
    """Saturated in the groups, so each fit returns the group's class share."""
    df = bucket_rows(spark)
    model = models.fit_logistic(df)
    assert evaluate.accuracy(model.transform(df)).first()["right"] == 8 + 8 + 7
    odds = model.intercepts[0.0] + model.weights[0.0][0]
    assert math.isclose(1 / (1 + math.exp(-odds)), 0.8, abs_tol=1e-3)
    tuned = models.tune_logistic(df, (0.0, 5.0))
    assert tuned.reg_param in (0.0, 5.0) and len(tuned.metrics) == 2


def test_experiments(spark, sf, lexicon):
    view = comments(spark, sf)
    small = {"buckets": 20, "lexicon": lexicon}
    rows = run_experiment(view, plan="all", mode="linear", reg_param=1.0, **small).collect()
    assert [(r["plan"], r["metric"]) for r in rows] == [
        (plan, metric) for plan in ("bag", "tfidf", "metadata") for metric in ("train_rmse", "test_rmse")
    ]
    # The bayes modes bring their own plan.
    (row, baseline) = run_experiment(view, plan="tfidf", mode="binary", **small).collect()
    assert (row["plan"], row["metric"]) == ("words", "test_accuracy")
    assert 0.5 <= baseline["value"] < 1


def test_experiment_bayes_equals_closed_form(spark, sf, lexicon):
    view = comments(spark, sf)
    rows = bayes_rows(view).cache()
    closed = evaluate.accuracy(bayes.predict(rows, bayes.fit(rows)), "label").first()["accuracy"]
    value = run_experiment(view, mode="binary", lexicon=lexicon).first()["value"]
    assert math.isclose(value, closed)


def test_fit_on_train_keeps_test_words_out(spark, sf):
    view = comments(spark, sf)
    rows = prepare_rows(view, Options())
    everything = prepare(rows, "words", True, Options())
    careful = prepare(rows, "words", True, Options(fit_on="train"))
    assert set(careful.fitted.vocabulary) < set(everything.fitted.vocabulary)


def test_ordered_split_of_an_experiment(spark, sf, lexicon):
    options = Options(split="ordered", buckets=20, lexicon=lexicon)
    data = prepare(prepare_rows(comments(spark, sf), options), "record", False, options)
    last, first = data.train.agg(F.max("id")).first()[0], data.test.agg(F.min("id")).first()[0]
    assert last < first
    assert data.train.count() == data.featured.count() * 60 // 100


def test_experiment_from_json_lines_with_text_ids(spark, sf, lexicon, tmp_path):
    view = comments(spark, sf)
    view.write.json(str(tmp_path / "json"))
    options = {"plan": "metadata", "mode": "linear", "lexicon": lexicon}
    stored = read_json_comments(spark, str(tmp_path / "json"))
    for ours, theirs in zip(
        run_experiment(stored, **options).collect(), run_experiment(view, **options).collect(), strict=True
    ):
        assert math.isclose(ours["value"], theirs["value"], rel_tol=1e-6)
    assert run_experiment(stored, limit=60, **options).count() == 2


def test_sentiment_that_is_there_is_kept(spark, real, lexicon):
    words = CommentTokenizer().transform(real)
    joined = with_sentiment(words, lexicon)
    kept = CommentFeatures().transform(joined).select("id", "sentiment").orderBy("id").collect()
    path = write_once(lexicon, "test-lexicon")
    by_stage = CommentFeatures(lexicon=path).transform(words).select("id", "sentiment")
    assert kept == by_stage.orderBy("id").collect()
    assert "sentiment" not in CommentFeatures().transform(words).columns


def test_plans_that_need_a_lexicon_say_so():
    for kind in PLANS:
        if kind != "words":
            with pytest.raises(ValueError):
                feature_plan(kind)
    with pytest.raises(ValueError):
        feature_plan("other")


@pytest.mark.parametrize("wrong", [{"split": "half"}, {"fit_on": "test"}, {"mode": "svm"}, {"plan": "none"}])
def test_unknown_options_are_refused(wrong):
    with pytest.raises(ValueError):
        Options(**wrong)


def test_bad_times_and_scores_do_not_end_a_fit(spark, sf, lexicon):
    view = comments(spark, sf)
    odd = [(9001, "ok text", "ann", "src1", "x", "4"), (9002, "more", "bob", "src1", None, "NaN"),
           (9003, "text", "eve", "src1", "12", "Infinity"), (9004, "text", "eve", "src1", "12", "2000000000")]
    rows = view.unionByName(spark.createDataFrame(odd, view.schema))
    report = report_experiment(rows, plan="metadata", mode="linear", lexicon=lexicon)
    assert all(math.isfinite(r["value"]) for r in report.metrics.collect())
    kept = keep_real_comments(view).count() + 2
    shares = report.distribution.collect()
    assert sum(r["comments"] for r in shares) == kept and max(r["high"] for r in shares) == 2**31


def test_random_split_of_an_experiment(spark, sf, lexicon):
    rows = prepare_rows(comments(spark, sf), Options(split="random", lexicon=lexicon))
    share = rows.where(F.col("part") == "train").count() / rows.count()
    assert 0.6 < share < 0.8


@pytest.mark.parametrize("reg", [0.0, 8.0])
def test_all_communities_at_once_equal_single_fits(spark, sf, lexicon, reg):
    view = comments(spark, sf).where("subreddit in ('src0', 'src1', 'src2')")
    got = {(r["subreddit"], r["metric"]): r["value"] for r in linear_per_community(view, lexicon, reg).collect()}
    for name in ("src0", "src1", "src2"):
        rows = prepare_rows(one_community(view, name), Options())
        fitted = feature_plan("metadata", lexicon=lexicon, tokenized=True).fit(rows)
        featured = fitted.transform(rows).select("part", "score_double", vector_to_array("features").alias("x")).collect()
        x, y = np.array([r["x"] for r in featured]), np.array([r["score_double"] for r in featured])
        train = np.array([r["part"] == "train" for r in featured])
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        used = sd > 0
        z = (x[:, used] - mean[used]) / sd[used]
        gram = z[train].T @ z[train] / train.sum() + reg / y[train].std() * np.eye(used.sum())
        slopes = np.linalg.pinv(gram, rcond=1e-10) @ (z[train].T @ (y[train] - y[train].mean()) / train.sum())
        errors = (y - y[train].mean() - z @ slopes) ** 2
        for metric, part in (("train_rmse", train), ("test_rmse", ~train)):
            assert math.isclose(got[name, metric], math.sqrt(errors[part].mean()), rel_tol=1e-5, abs_tol=1e-6)


def test_ridge_per_community_is_sparks(spark):
    _, _, df = points(spark)
    rows = df.select(F.lit("g").alias("g"), F.col("score_double").alias("y"), vector_to_array("features").alias("x"))
    ours, model = solve_by_group(rows, ["g"], 2.0).first(), models.fit_linear(df, 2.0)
    np.testing.assert_allclose(ours["weights"], model.coefficients.toArray(), rtol=1e-8)
    assert math.isclose(ours["intercept"], model.intercept, rel_tol=1e-8)


def test_limit(spark, sf, lexicon):
    options = Options(limit=50, lexicon=lexicon)
    data = prepare(prepare_rows(comments(spark, sf), options), "metadata", False, options)
    assert data.featured.count() == 50


def test_explained_weights(spark, sf, lexicon):
    view = comments(spark, sf)
    rows = explain_experiment(view, plan="metadata", mode="ridge", regs=(0.0, 8.0), lexicon=lexicon)
    assert {row["side"] for row in rows.collect()} == {"top", "bottom"}
    assert rows.count() == 20
    assert explain_experiment(view, plan="metadata", mode="forest", lexicon=lexicon).count() == 0
    arms = explain_experiment(view, plan="bin_class", reg_param=0.125, lexicon=lexicon)
    assert {row["mode"] for row in arms.collect()} == {"binary", "logistic"}


def test_last_and_first_predictions(spark):
    rows = [(i, "b", ["w"], float(i), float(i + 1)) for i in range(30)]
    df = spark.createDataFrame(
        rows, "id int, body string, words array<string>, score_double double, prediction double"
    )
    assert [r["id"] for r in evaluate.prediction_sample(df).collect()] == list(range(10))
    assert [r["id"] for r in evaluate.last_predictions(df).collect()] == [29, 28, 27, 26, 25]
    assert evaluate.regression_errors(df).first()["rmse"] == 1.0


def test_accuracy_of_no_rows(spark):
    empty = spark.createDataFrame([], "score_bucket double, prediction double")
    assert tuple(evaluate.accuracy(empty).first()) == (0, 0, None)


def test_scores_that_are_no_numbers_are_left_out(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, score string")
    assert [row["id"] for row in with_score(df).collect()] == [1]


def test_an_unlimited_vocabulary_stays_off_the_driver(spark, lexicon, monkeypatch):
    """Same vectors as Spark's own bag and assembler, rows with equal, null and empty word lists included; no slot has a name in the schema."""
    texts = ["best idiot best ab", "best idiot best ab", "cd ab http://x.example.com?", "", "zz zz"]
    rows = [(i if i < 4 else None, t, None, "3600", str(i)) for i, t in enumerate(texts)]
    view = spark.createDataFrame(rows + rows[:1], "id long, body string, author string, created_utc string, score string")
    whole = fit_features(view, feature_plan("record", buckets=None, lexicon=lexicon))
    held = fit_features(view, feature_plan("record", buckets=1000, lexicon=lexicon))
    assert not isinstance(whole.model.stages[2], CountVectorizerModel)
    assert whole.vocabulary == held.vocabulary == ["best", "ab", "idiot", "zz", "cd", "com", "example", "http"]
    dense = lambda fitted: sorted(fitted.transform(view).select("body", vector_to_array("features")).collect())
    assert dense(whole) == dense(held) and len(dense(whole)) == 6
    assert not whole.transform(view).schema["features"].metadata


def test_bag_features_shuffle_no_text(spark, real, lexicon):
    """The rows meet their sentiment without body and words, and stop words leave the counts, not every row."""
    rows = settle(CommentTokenizer().transform(real), "test-tokenized")
    fitted = fit_features(rows, feature_plan("bag", buckets=30, lexicon=lexicon, tokenized=True))
    plan = fitted.transform(rows).select("id", "features")._jdf.queryExecution().optimizedPlan().toString()
    left_side = plan[plan.index("LeftOuter") :].split("\n")[1]
    assert re.search(r"[\[ ]body#|[\[ ]words#", left_side) is None and "filtered" not in plan
    stop = StopWordsRemover(inputCol="words", outputCol="f")
    plain = VocabularyCounter(inputCol="f", vocabSize=30).fit(stop.transform(rows))
    assert plain.vocabulary == fitted.vocabulary
    bags = plain.transform(stop.transform(rows)).select("id", "words_features").orderBy("id").collect()
    assert bags == fitted.transform(rows).select("id", "words_features").orderBy("id").collect()

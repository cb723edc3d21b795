"""Spark ML stages whose work is DataFrame code, so plans stay free of UDFs.

They save and load like any other stage and sit in a `Pipeline` next to
Spark's own `StopWordsRemover`, `HashingTF`, `IDF`, `OneHotEncoder`, `PCA` and
`VectorAssembler`.
"""

from __future__ import annotations

import uuid

from pyspark import SparkContext, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, PCAModel
from pyspark.ml.linalg import DenseMatrix, DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions import scores, text
from scorelens.functions.vectors import SPARSE, settled_vectors, sparse_vector
from scorelens.operators.lexicon import with_lexicon_words, with_sentiment
from scorelens.operators.pca import principal_components
from scorelens.operators.quantile import upper_quartile
from scorelens.operators.vocabulary import counted_in_rows, join_on_term, ranked_terms, term_uses, top_terms
from scorelens.session import delete, settle, write_once

HOURS = 24

# The widest vocabulary that is handed to Spark's own bag, which every process holds whole.
HELD_TERMS = 2**18


class _HasLexicon(Params):
    """A written lexicon (word, valence) of any size, and the rows' unique key; see `operators.lexicon`."""

    lexicon = Param(Params._dummy(), "lexicon", "folder of the lexicon's Parquet table", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "unique column", TypeConverters.toString)

    def entries(self, dataset: DataFrame) -> DataFrame | None:
        path = self.getOrDefault(self.lexicon)
        return dataset.sparkSession.read.parquet(path) if path else None


class CommentTokenizer(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Lower-case, split on blanks, delete everything but letters and digits."""

    @keyword_only
    def __init__(self, *, inputCol: str = "body", outputCol: str = "words"):
        super().__init__()
        self._setDefault(inputCol="body", outputCol="words")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), text.clean_tokens(F.col(self.getInputCol())))


class LexiconFilter(
    Transformer, HasInputCol, HasOutputCol, _HasLexicon, DefaultParamsReadable, DefaultParamsWritable
):
    """Keep lexicon words only and drop rows that have none."""

    @keyword_only
    def __init__(
        self, *, inputCol: str = "words", outputCol: str = "filtered", lexicon: str = "", key: str = "id"
    ):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="filtered", lexicon="", key="id")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        entries = self.entries(dataset)
        if entries is None:
            raise ValueError("this stage needs a lexicon")
        return with_lexicon_words(
            dataset, entries, self.getInputCol(), self.getOutputCol(), self.getOrDefault(self.key)
        )


class CommentFeatures(Transformer, _HasLexicon, DefaultParamsReadable, DefaultParamsWritable):
    """Score, lengths, links, punctuation, hour and sentiment of each comment.

    A `sentiment` column that is there already is kept; without one and without
    a lexicon there is none.

    The hour is marked as nominal with 24 values, so that one-hot encoding has
    the same width whatever hours the data holds. A time that can't be read
    counts as the last hour, whose block is all zeros.
    """

    @keyword_only
    def __init__(self, *, lexicon: str = "", key: str = "id"):
        super().__init__()
        self._setDefault(lexicon="", key="id")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        hour = {"ml_attr": {"type": "nominal", "name": "hour", "num_vals": HOURS}}
        featured = with_comment_features(dataset, self.entries(dataset), self.getOrDefault(self.key))
        return featured.withColumn("hour", F.coalesce("hour", F.lit(HOURS - 1.0))).withMetadata("hour", hour)


def with_comment_features(df: DataFrame, entries: DataFrame | None, key: str = "id") -> DataFrame:
    """The rows meet their sentiment last: where nothing reads the texts any more, they are not shuffled."""
    body, words = F.col("body"), F.col("words")
    features = {
        "score_double": scores.score_double(F.col("score")),
        "words_count": text.words_count(words),
        "chars_count": text.chars_count(words),
        "avg_word_length": text.mean_or_zero(text.chars_count(words), text.words_count(words)),
        "link_count": text.link_count(body),
        "hour": text.hour_of_day(F.col("created_utc")),
        "question_mark": text.char_count(body, "?"),
        "excl_mark": text.char_count(body, "!"),
    }
    featured = df.withColumns(features)
    if entries is None or "sentiment" in df.columns:
        return featured
    order = [*df.columns, "sentiment", *(c for c in features if c not in df.columns)]
    return with_sentiment(featured, entries, key=key).select(*order)


class RecordFeatures(Transformer, _HasLexicon, DefaultParamsReadable, DefaultParamsWritable):
    """The single-record variant: lengths of the raw body, and sentiment over word runs.

    Words are split on single spaces here, and lexicon words of valence 0 do
    not count in the mean.
    """

    @keyword_only
    def __init__(self, *, lexicon: str = "", key: str = "id"):
        super().__init__()
        self._setDefault(lexicon="", key="id")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_record_features(dataset, self.entries(dataset), self.getOrDefault(self.key))


def with_record_features(df: DataFrame, entries: DataFrame | None, key: str = "id") -> DataFrame:
    body = F.col("body")
    df = df.withColumn("words", text.word_runs(body))
    if entries is not None:
        df = with_sentiment(df, entries, skip_zero=True, key=key)
    return df.withColumns(
        {
            "score_double": scores.score_double(F.col("score")),
            "body_chars": F.length(body),
            "link_count": text.link_count(body),
            "space_words": text.space_words_count(body),
            "space_word_length": text.space_word_length(body),
        }
    )


def _count_model(terms: list[str], input_column: str, output_column: str) -> CountVectorizerModel:
    """`CountVectorizerModel.from_vocabulary`, the terms handed to the JVM as one text.

    Term by term, a vocabulary of 2^18 takes about a minute to hand over.
    """
    jvm = SparkContext._active_spark_context._jvm
    array = jvm.org.apache.commons.lang3.StringUtils.splitPreserveAllTokens("\n".join(terms), "\n")
    if len(array) != len(terms):
        return CountVectorizerModel.from_vocabulary(terms, inputCol=input_column, outputCol=output_column)
    model = CountVectorizerModel._create_from_java_class(
        "org.apache.spark.ml.feature.CountVectorizerModel", array
    )
    return model._set(inputCol=input_column, outputCol=output_column, vocabSize=len(terms))


class VocabularyCounter(
    Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Bag of words over the `vocabSize` most used terms.

    Fits to Spark's `CountVectorizerModel`, for more than HELD_TERMS to a
    `WrittenVocabularyModel`. Unlike Spark's own fit, terms of equal use come in
    term order, so the vocabulary never changes between runs.
    """

    vocabSize = Param(Params._dummy(), "vocabSize", "terms kept", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words that are no terms, in any case", TypeConverters.toListString)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "filtered",
        outputCol: str = "words_features",
        vocabSize: int = 2**18,
        stopWords: list[str] = (),
    ):
        super().__init__()
        self._setDefault(inputCol="filtered", outputCol="words_features", vocabSize=2**18, stopWords=[])
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel | WrittenVocabularyModel:
        uses = term_uses(dataset, self.getInputCol())
        if stop := [word.lower() for word in self.getOrDefault(self.stopWords)]:
            # A stop word leaves once here, not at each of its uses; a bag passes over what is no term.
            uses = uses.where(~F.lower("term").isin(stop))
        uses = settle(uses, "term-uses")
        best = top_terms(uses, self.getOrDefault(self.vocabSize))
        if self.getOrDefault(self.vocabSize) > HELD_TERMS:
            path = write_once(ranked_terms(best), "vocabulary")
            size = dataset.sparkSession.read.parquet(path).count()
            return WrittenVocabularyModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), terms=path, size=size)
        best = best.select("term", "uses").collect()
        terms = [row["term"] for row in sorted(best, key=lambda row: (-row["uses"], row["term"]))]
        return _count_model(terms, self.getInputCol(), self.getOutputCol())


class WrittenVocabularyModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Bag of words over a written vocabulary (term, uses, slot) of any size, which no process holds whole.

    A row's terms are counted in the row and meet their slots in a join; the
    vectors are as long as the row has terms. Rows are told apart by a number
    that is written with them. A null word array has an empty bag.
    """

    terms = Param(Params._dummy(), "terms", "folder of the vocabulary's Parquet table", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "terms of the vocabulary", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol: str = "filtered", outputCol: str = "words_features", terms: str = "", size: int = 0
    ):
        super().__init__()
        self._setDefault(inputCol="filtered", outputCol="words_features", terms="", size=0)
        self._set(**self._input_kwargs)

    def table(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.getOrDefault(self.terms))

    @property
    def vocabulary(self) -> list[str]:
        """All terms in slot order, for vocabularies that the driver can hold."""
        return [row["term"] for row in sorted(self.table().collect(), key=lambda row: row["slot"])]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words, bag = self.getInputCol(), self.getOutputCol()
        number, entries = f"{bag}_row", f"{bag}_entries"
        spark = dataset.sparkSession
        copies = [write_once(dataset.withColumn(number, F.monotonically_increasing_id()), "bag-rows")]
        rows = spark.read.schema(dataset.withColumn(number, F.lit(0).cast("bigint")).schema).parquet(copies[0])
        copies.append(write_once(counted_in_rows(rows, words, number), "bag-counts"))
        counted = spark.read.parquet(copies[1])
        found = join_on_term(counted, self.table())
        entry = F.struct("slot", F.col("tf").alias("value"))
        bags = found.groupBy(number).agg(F.array_sort(F.collect_list(entry)).alias(entries))
        slots, counts = (F.coalesce(F.col(entries)[name], F.array()) for name in ("slot", "value"))
        parts = sparse_vector(F.lit(self.getOrDefault(self.size)), slots, counts.cast("array<double>"))
        made = settled_vectors(rows.join(bags, number, "left").withColumn(bag, parts).drop(number, entries), bag, "bags")
        for path in copies:
            delete(spark, path)
        return made


class SparseAssembler(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers and vectors side by side in a sparse vector, without a name for every slot in the schema.

    Spark's `VectorAssembler` makes an attribute per slot on the driver. Null
    and NaN are errors, as they are there.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] = (), outputCol: str = "features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        start, slots, values = F.lit(0), [], []
        for name in self.getInputCols():
            if isinstance(dataset.schema[name].dataType, VectorUDT):
                parts = F.unwrap_udt(name)
                whole = F.sequence(F.lit(0), F.size(parts["values"]) - 1)
                slots.append(_moved(F.when(parts["type"] == SPARSE, parts["indices"]).otherwise(whole), start))
                values.append(parts["values"])
                start = start + F.coalesce(parts["size"], F.size(parts["values"]))
            else:
                value = F.col(name).cast("double")
                slots.append(F.when(value == 0, F.array().cast("array<int>")).otherwise(F.array(start.cast("int"))))
                values.append(F.when(value == 0, F.array().cast("array<double>")).otherwise(F.array(value)))
                start = start + 1
        every = F.concat(*values)
        bad = every.isNull() | F.exists(every, lambda v: v.isNull() | F.isnan(v))
        every = F.when(bad, F.raise_error(F.lit("a feature is null or NaN")).cast("array<double>")).otherwise(every)
        vector = sparse_vector(start, F.concat(*slots), every)
        return settled_vectors(dataset.withColumn(self.getOutputCol(), vector), self.getOutputCol(), "assembled")


def _moved(slots: Column, start: Column) -> Column:
    return F.transform(slots, lambda slot: (slot + start).cast("int"))


def _pca_model(loadings, shares, input_column: str, output_column: str) -> PCAModel:
    """Spark's PCAModel from loadings that were found elsewhere; the library has no public constructor for it."""
    sc = SparkContext._active_spark_context
    matrix = DenseMatrix(loadings.shape[0], loadings.shape[1], loadings.ravel(order="F").tolist())
    made = PCAModel._new_java_obj(
        "org.apache.spark.ml.feature.PCAModel",
        PCAModel().uid,
        _py2java(sc, matrix),
        _py2java(sc, DenseVector(shares)),
    )
    model = PCAModel(made)
    model._resetUid(made.uid())
    return model._set(inputCol=input_column, outputCol=output_column, k=loadings.shape[1])


def classifier_model(weights, intercepts) -> LogisticRegressionModel:
    """Spark's classifier from a row of weights per class that were found elsewhere; one class is written twice."""
    sc = SparkContext._active_spark_context
    if len(weights) == 1:
        weights, intercepts = weights.repeat(2, axis=0), intercepts.repeat(2)
    made = LogisticRegressionModel._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel",
        f"LogisticRegression_{uuid.uuid4().hex[:12]}",
        _py2java(sc, DenseMatrix(weights.shape[0], weights.shape[1], weights.ravel(order="F").tolist())),
        _py2java(sc, DenseVector(intercepts)),
        len(weights),
        True,
    )
    model = LogisticRegressionModel(made)
    model._resetUid(made.uid())
    return model


def linear_model(intercept: float, weights) -> LinearRegressionModel:
    """Spark's linear model from weights that were found elsewhere."""
    sc = SparkContext._active_spark_context
    made = LinearRegressionModel._new_java_obj(
        "org.apache.spark.ml.regression.LinearRegressionModel",
        f"LinearRegression_{uuid.uuid4().hex[:12]}",
        _py2java(sc, DenseVector(weights)),
        float(intercept),
    )
    model = LinearRegressionModel(made)
    model._resetUid(made.uid())
    return model


class TermPCA(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Principal components by subspace iteration; fits to Spark's `PCAModel`.

    Takes vocabularies that Spark's own fit, a dense slots x slots matrix on the
    driver, can't.
    """

    k = Param(Params._dummy(), "k", "components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "words_features", outputCol: str = "words_reduced", k: int = 10):
        super().__init__()
        self._setDefault(inputCol="words_features", outputCol="words_reduced", k=10)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PCAModel:
        vector = self.getInputCol()
        width = dataset.select(F.unwrap_udt(vector).alias("v")).select(
            F.coalesce("v.size", F.size("v.values"))
        ).first()[0]
        loadings, shares = principal_components(dataset, vector, width, min(width, self.getOrDefault(self.k)))
        return _pca_model(loadings, shares, vector, self.getOutputCol())


class _LabelParams(HasInputCol, HasOutputCol):
    binary = Param(Params._dummy(), "binary", "quartile label, not log bucket", TypeConverters.toBoolean)


class ScoreLabeler(Estimator, _LabelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the exact upper quartile and the highest score."""

    @keyword_only
    def __init__(
        self, *, inputCol: str = "score_double", outputCol: str = "score_bucket", binary: bool = False
    ):
        super().__init__()
        self._setDefault(inputCol="score_double", outputCol="score_bucket", binary=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScoreLabelerModel:
        fitted = upper_quartile(dataset, self.getInputCol()).first()
        if fitted is None:
            raise ValueError("no row has a score")
        return ScoreLabelerModel(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            binary=self.getOrDefault(self.binary),
            threshold=fitted["threshold"],
            maxScore=fitted["max_score"],
        )


class ScoreLabelerModel(Model, _LabelParams, DefaultParamsReadable, DefaultParamsWritable):
    threshold = Param(Params._dummy(), "threshold", "upper quartile of the scores", TypeConverters.toFloat)
    maxScore = Param(Params._dummy(), "maxScore", "highest score", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "score_double",
        outputCol: str = "score_bucket",
        binary: bool = False,
        threshold: float = 0.0,
        maxScore: float = 0.0,
    ):
        super().__init__()
        self._setDefault(
            inputCol="score_double", outputCol="score_bucket", binary=False, threshold=0.0, maxScore=0.0
        )
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = F.col(self.getInputCol())
        if self.getOrDefault(self.binary):
            label = scores.binary_label(score, self.getOrDefault(self.threshold))
        else:
            label = scores.log_bucket(score)
        return dataset.withColumn(self.getOutputCol(), label)

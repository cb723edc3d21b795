"""Feature plans: which stages turn a comment into a feature vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    HashingTF,
    OneHotEncoder,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators.labels import with_score
from scorelens.operators.lexicon import unique_entries
from scorelens.plans.stages import (
    HELD_TERMS,
    HOURS,
    CommentFeatures,
    CommentTokenizer,
    LexiconFilter,
    RecordFeatures,
    ScoreLabeler,
    ScoreLabelerModel,
    SparseAssembler,
    TermPCA,
    VocabularyCounter,
    WrittenVocabularyModel,
)
from scorelens.session import delete, write_once

# Vocabulary or bucket count asked for by default, and the
# vocabulary of the words-only plan.
DEFAULT_BUCKETS = 50_000
WORDS_ONLY_VOCABULARY = 2**18
ALL_TERMS = 2**31 - 1

# Fixed value: the vocabulary of the component plan.
PCA_VOCABULARY = 50_000

# The slots of each plan, in order, and the names of the plans.
METADATA = ["chars_count", "avg_word_length", "link_count", "words_count", "hour_encoded", "sentiment"]
PUNCTUATION = ["question_mark", "excl_mark"]
RECORD = ["body_chars", "link_count", "space_words", "space_word_length", "sentiment"]
PLANS = ("bag", "sentiment", "metadata", "tfidf", "pca", "words", "record")


def feature_plan(
    kind: str = "bag",
    *,
    buckets: int | None = DEFAULT_BUCKETS,
    lexicon: DataFrame | None = None,
    tokenized: bool = False,
    binary: bool = False,
    stop_words: Sequence[str] | None = None,
    pca_vocabulary: int = PCA_VOCABULARY,
) -> Pipeline:
    """The stages of one plan.

    bag: stop words removed, counts of the top `buckets` terms, metadata.
    sentiment: lexicon words only, rows without any dropped; no punctuation counts.
    metadata: no word vector.
    tfidf: `buckets` hashed counts weighted by IDF, stop words kept, metadata.
    pca: `buckets` principal components of a bag of `pca_vocabulary` terms, metadata.
    words: counts of the top 2^18 terms and nothing else.
    record: raw-body lengths, links, sentiment, counts of the top `buckets` word runs.

    `lexicon` is a frame (word, valence), needed by every plan but `words`; it
    is written once and the stages name the written copy. Where `buckets` is a
    vocabulary, None keeps all terms; one of more than 2^18 terms is a written
    table and its slots are not named in the schema. With `tokenized`, the rows bring their
    cleaned tokens as `words` (not for `record`, which has its own).
    """
    if kind not in PLANS:
        raise ValueError(f"no plan {kind!r}; there are {', '.join(PLANS)}")
    if lexicon is None and kind != "words":
        raise ValueError(f"plan {kind!r} needs a lexicon")
    entries = "" if lexicon is None else write_once(unique_entries(lexicon), "lexicon")
    buckets = ALL_TERMS if buckets is None else buckets
    stop = StopWordsRemover(inputCol="words", outputCol="filtered")
    if stop_words is not None:
        stop = stop.setStopWords(list(stop_words))

    def bag(size: int) -> VocabularyCounter:
        # Of the words with the stop words in between: the vocabulary has none, so the bag is that of `filtered`.
        words, gone = ("filtered", []) if kind == "sentiment" else ("words", stop.getStopWords())
        return VocabularyCounter(inputCol=words, outputCol="words_features", vocabSize=size, stopWords=gone)

    def assembled(columns: list[str]) -> Transformer:
        if buckets > HELD_TERMS and kind in ("bag", "sentiment", "record"):
            return SparseAssembler(inputCols=columns, outputCol="features")
        return VectorAssembler(inputCols=columns, outputCol="features")

    if kind == "record":
        return Pipeline(
            stages=[
                RecordFeatures(lexicon=entries),
                # The bag is the last stage that is fitted: no row is transformed by it before the plan is.
                ScoreLabeler(binary=binary),
                VocabularyCounter(inputCol="words", outputCol="words_features", vocabSize=buckets),
                assembled([*RECORD, "words_features"]),
            ]
        )
    every = METADATA + PUNCTUATION
    vectorise, inputs = {
        "bag": ([stop, bag(buckets)], ["words_features", *every]),
        "sentiment": (
            [LexiconFilter(inputCol="words", outputCol="filtered", lexicon=entries), bag(buckets)],
            ["words_features", *METADATA],
        ),
        "metadata": ([], every),
        "tfidf": (
            [
                HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets),
                IDF(inputCol="tf", outputCol="words_features"),
            ],
            ["words_features", *every],
        ),
        "pca": (
            [
                stop,
                bag(pca_vocabulary),
                TermPCA(k=buckets, inputCol="words_features", outputCol="words_reduced"),
            ],
            ["words_reduced", *every],
        ),
        "words": ([stop, bag(WORDS_ONLY_VOCABULARY)], ["words_features"]),
    }[kind]
    return Pipeline(
        stages=[
            *([] if tokenized else [CommentTokenizer()]),
            *vectorise,
            CommentFeatures(lexicon=entries),
            ScoreLabeler(binary=binary),
            OneHotEncoder(inputCols=["hour"], outputCols=["hour_encoded"]),
            assembled(inputs),
        ]
    )


class FittedFeatures:
    """A fitted plan. Its parts are found by type, wherever they sit."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, comments: DataFrame) -> DataFrame:
        return self.model.transform(comments)

    def narrow(self, comments: DataFrame, *keep: str) -> DataFrame:
        """The transformed rows, of which only `keep` is needed: what no later stage reads is not written again.

        A written bag goes as soon as the vectors made of it are written.
        """
        rows, stages = comments, self.model.stages
        for i, stage in enumerate(stages):
            read = (WrittenVocabularyModel, SparseAssembler)
            if all(isinstance(s, read) for s in stages[i:]):
                used = {c for s in stages[i:] for c in (s.getInputCols() if isinstance(s, SparseAssembler) else [s.getInputCol()])}
                rows = rows.select(*(c for c in rows.columns if c in used or c in keep))
            before, rows = rows, stage.transform(rows)
            if isinstance(stage, SparseAssembler) and isinstance(stages[i - 1], WrittenVocabularyModel):
                for folder in {file.rpartition("/")[0] for file in before.inputFiles()}:
                    delete(rows.sparkSession, folder)
        return rows.select(*keep)

    def featured(self, comments: DataFrame, *keep: str) -> DataFrame:
        """Only what fits and evaluations read, and no per-slot metadata.

        A bag of 50,000 terms would otherwise put 50,000 attribute records into
        the schema, and with it into every file footer.
        """
        rows = self.narrow(comments, "id", *keep, "score_double", "score_bucket", "features").where(F.col("score_double").isNotNull())
        plain = F.col("features").alias("features", metadata={})
        return rows.select("id", *keep, "score_double", "score_bucket", plain)

    @property
    def vocabulary(self) -> list[str]:
        """Terms of the word slots; empty where the slots are not single terms."""
        if "words_features" not in self.input_columns:
            return []
        bags = (CountVectorizerModel, WrittenVocabularyModel)
        return next((s.vocabulary for s in self.model.stages if isinstance(s, bags)), [])

    @property
    def labeler(self) -> ScoreLabelerModel:
        return next(s for s in self.model.stages if isinstance(s, ScoreLabelerModel))

    @property
    def input_columns(self) -> list[str]:
        return self.model.stages[-1].getInputCols()

    def _plain_names(self) -> dict[str, list[str]]:
        """Names of the slots of each input column, that of the words being one."""
        blocks = {column: [column] for column in self.input_columns}
        if "hour_encoded" in blocks:
            blocks["hour_encoded"] = [f"hour={hour}" for hour in range(HOURS - 1)]
        return blocks

    def names(self, width: int) -> list[str]:
        """A name for each of the `width` feature slots, in slot order."""
        blocks = self._plain_names()
        for column in ("words_features", "words_reduced"):
            if column in blocks:
                unnamed = width - sum(len(names) for other, names in blocks.items() if other != column)
                terms = [f"word {term}" for term in self.vocabulary]
                blocks[column] = terms or [f"Feature {slot}" for slot in range(unnamed)]
        return [name for names in blocks.values() for name in names]

    def names_of(self, slots: Sequence[int], width: int) -> list[str]:
        """The names of a few slots; of a written vocabulary only their terms are read."""
        bag = next((s for s in self.model.stages if isinstance(s, WrittenVocabularyModel)), None)
        if bag is None:
            names = self.names(width)
            return [names[slot] for slot in slots]
        blocks = list(self._plain_names().items())
        at = self.input_columns.index("words_features")
        before, after = ([name for _, names in part for name in names] for part in (blocks[:at], blocks[at + 1 :]))
        words = range(len(before), width - len(after))
        wanted = [slot - words.start for slot in slots if slot in words]
        terms = {row["slot"]: f"word {row['term']}" for row in bag.table().where(F.col("slot").isin(wanted)).collect()}
        name = lambda slot: terms[slot - words.start] if slot in words else before[slot] if slot < words.start else after[slot - words.stop]
        return [name(slot) for slot in slots]


def fit_features(comments: DataFrame, plan: Pipeline) -> FittedFeatures:
    return FittedFeatures(plan.fit(with_score(comments)))

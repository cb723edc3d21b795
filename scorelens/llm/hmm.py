"""Hidden Markov language model over word symbols.

The words that are used most are symbols of their own; every other word is
known to the states by its spelling class, and within its class by its share
of the class's uses (one added to each count, one place for the unseen). So the
states' tables have a bounded size, while the word counts grow with the corpus
and are joined, never broadcast. Training is Baum-Welch: tasks return expected
counts, Spark adds them up. Scoring is the scaled forward recursion over whole
documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.texts import only, slices
from scorelens.session import settle

STATES = 8
ROUNDS = 5
SEED = 42
OWN_SYMBOLS = 8192
LOCAL_WORDS = 65_536
LONGEST_LOCAL = 64
FLUSH_WORDS = 300_000
STRETCH = 256
STRETCHES = 2048
PRIOR = 2.0
LEFT_OUT, MODULO = 2, 7
END = b""
STOPS, LETTERS = b".,;:!?", bytes([*range(97, 123), *range(128, 256)])
OTHER_BYTES = bytes(b for b in range(256) if b not in LETTERS)
SUFFIXES = 256
CLASSES = 3 * SUFFIXES


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % MODULO == LEFT_OUT, F.lit(False))


def spelling_class(word: bytes) -> int:
    """Number of the class given by how a word ends."""
    last = word[-1:]
    kind = 0 if last in LETTERS else 1 if last in STOPS else 2
    return kind * SUFFIXES + zlib.crc32(word.rstrip(OTHER_BYTES)[-3:]) % SUFFIXES


def word_counts(docs: DataFrame) -> DataFrame:
    """word (lower-cased bytes, empty for the end of a text), class, c over all rows of `docs`."""

    def out(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        classes = [spelling_class(w) for w in words]
        return pa.record_batch(
            [pa.array(words, pa.binary()), pa.array(classes, pa.int32()), pa.array(counts.values(), pa.int64())],
            ["word", "class", "c"],
        )

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch):
                for text in texts:
                    counts.update((text or b"").lower().split())
                counts[END] += len(texts)
                if len(counts) > FLUSH_WORDS:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    partial = docs.select("text").mapInArrow(each, "word binary, class int, c bigint")
    return partial.groupBy("word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What a task needs to turn words into symbols and to count for the frequent ones."""

    tokens: int
    words: int
    counts: dict[bytes, int]
    symbols: dict[bytes, int]
    class_uses: np.ndarray
    class_words: np.ndarray

    @property
    def size(self) -> int:
        return len(self.symbols) + CLASSES


def _at_least(counts: DataFrame, most: int) -> float:
    """A count that at most `most` words reach, from a histogram of a few hundred cells of equal ratio."""
    cell = F.floor(F.log2("c") * 16)
    cells = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    reached, least = 0, math.inf
    for row in sorted(cells, key=lambda r: -r["cell"]):
        reached += row["n"]
        if reached > most:
            break
        least = row["c"]
    return least


def lexicon(counts: DataFrame, own: int = OWN_SYMBOLS, local: int = LOCAL_WORDS) -> Lexicon:
    """From the written word counts; `own` and `local` bound what tasks are sent, every other word is joined."""
    short = counts.where(F.octet_length("word") <= LONGEST_LOCAL)
    kept = short.where(F.col("c") >= min(_at_least(short, local), 2**62)).select("word", "c").collect()
    kept = sorted(((bytes(r["word"]), r["c"]) for r in kept), key=lambda r: (-r[1], r[0]))
    symbols = {w: i for i, w in enumerate(sorted({END, *(w for w, _ in kept[: own - 1])}))}
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    uses, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        uses[row["class"]], kinds[row["class"]] = row["c"], row["n"]
    for word, c in kept:
        if word in symbols:
            uses[spelling_class(word)] -= c
            kinds[spelling_class(word)] -= 1
    if END in symbols and not any(w == END for w, _ in kept) and words:
        end = counts.where(F.col("word") == F.lit(END)).select("c").first()
        if end:
            uses[spelling_class(END)] -= end["c"]
            kinds[spelling_class(END)] -= 1
            kept.append((END, end["c"]))
    return Lexicon(tokens, words, dict(kept), symbols, uses, kinds)


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Per row: symbols, and what its frequent words add; its other words, to be joined.

    Columns doc_id, held_out, symbols (little-endian 16-bit), n_tokens,
    n_known, base, inside (log10 shares within classes) and rare (word, class, n).
    """
    # Plain values: broadcasts are pickled by reference to their classes, which workers may lack.
    sent = docs.sparkSession.sparkContext.broadcast(vars(lex))
    schema = (
        "doc_id bigint, held_out boolean, symbols binary, n_tokens bigint, n_known bigint, base double, "
        "inside double, rare array<struct<word:binary,class:int,n:bigint>>"
    )
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())]))
    types = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type]
    names = [part.split()[0] for part in schema.split(", ")]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(**sent.value)
        first = len(lex.symbols)
        whole = lex.tokens + lex.words + 1

        class Places(dict):
            """Place of each frequent word in the arrays below; -1, their last place, for all others."""

            def __missing__(self, word: bytes) -> int:
                return -1

        places = Places()
        # Of each frequent word: symbol, log10 of the base share and of the share within its class.
        symbol_of, base_of, inside_of = np.zeros(len(lex.counts) + 1, "<u2"), np.zeros(len(lex.counts) + 1), np.zeros(len(lex.counts) + 1)
        for i, (word, c) in enumerate(lex.counts.items()):
            places[word] = i
            base_of[i] = math.log10((c + 1) / whole)
            if word in lex.symbols:
                symbol_of[i] = lex.symbols[word]
            else:
                kind = spelling_class(word)
                symbol_of[i] = first + kind
                inside_of[i] = math.log10((c + 1) / (lex.class_uses[kind] + lex.class_words[kind] + 1))
        for batch in batches:
            ids, out_of_train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, texts in slices(batch):
                rows = []
                for i, text in enumerate(texts, start):
                    words = (text or b"").lower().split()
                    words.append(END)
                    at = np.fromiter(map(places.__getitem__, words), "int32", len(words))
                    made, others, rare = symbol_of[at], np.flatnonzero(at < 0).tolist(), []
                    if others:
                        kinds = {}
                        for word, n in Counter([words[o] for o in others]).items():
                            kinds[word] = kind = spelling_class(word)
                            rare.append({"word": word, "class": kind, "n": n})
                        # The end of a text is a symbol even where no row is learnt from.
                        made[others] = [lex.symbols.get(words[o], first + kinds[words[o]]) for o in others]
                    known = len(words) - len(others)
                    rows.append((ids[i], out_of_train[i], made.tobytes(), len(words), known, base_of[at].sum(), inside_of[at].sum(), rare))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(each, schema)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x symbols


def first_model(frequencies: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """Symbol frequencies with seeded noise in each state; states tend to stay."""
    rng = np.random.default_rng(seed)
    emit = frequencies * np.exp(rng.normal(0, 1.0, (states, len(frequencies))))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def forward_backward(model: Model, lines: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions of symbol rows, longest first, padded behind their lengths."""
    rows, steps = lines.shape
    states = len(model.start)
    table = np.ascontiguousarray(model.emit.T)
    alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    alpha, scale = np.empty((steps, rows, states)), np.ones((steps, rows))
    for t in range(steps):
        n = alive[t]
        now = (model.start if t == 0 else alpha[t - 1, :n] @ model.move) * table[lines[:n, t]]
        total = now.sum(axis=1)
        scale[t, :n] = total
        alpha[t, :n] = now / total[:, None]
    moves, emits = np.zeros((states, states)), np.zeros((model.emit.shape[1], states))
    beta = np.ones((rows, states))
    posts, symbols = [], []
    starts = np.zeros(states)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        post = alpha[t, :n] * beta[:n]
        posts.append(post)
        symbols.append(lines[:n, t])
        if t == 0:
            starts = post.sum(axis=0)
        else:
            ahead = table[lines[:n, t]] * beta[:n] / scale[t, :n, None]
            moves += alpha[t - 1, :n].T @ ahead
            beta[:n] = ahead @ model.move.T
    symbols, posts = np.concatenate(symbols), np.concatenate(posts)
    for k in range(states):
        emits[:, k] = np.bincount(symbols, posts[:, k], len(emits))
    return starts, moves * model.move, emits.T


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of symbol stretches, longest first; long documents give several, every symbol is in one."""
    held: list[np.ndarray] = []

    def matrix(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        some = sorted(some, key=len, reverse=True)
        lengths = np.array([len(s) for s in some])
        lines = np.zeros((len(some), lengths[0]), "uint16")
        for i, s in enumerate(some):
            lines[i, : len(s)] = s
        return lines, lengths

    for batch in batches:
        for value in batch.column(0):
            line = np.frombuffer(value.as_buffer(), "<u2")
            held += [line[i : i + STRETCH] for i in range(0, len(line), STRETCH)]
        while len(held) >= STRETCHES:
            yield matrix(held[:STRETCHES])
            held = held[STRETCHES:]
    if held:
        yield matrix(held)


def expected_counts(lines: DataFrame, model: Model) -> Model:
    """One Baum-Welch pass over all rows; tasks return sums, which are added per cell of the tables."""
    sent = lines.sparkSession.sparkContext.broadcast(vars(model))
    states, symbols = model.emit.shape

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        total = np.zeros(states + states * states + states * symbols)
        for matrix, lengths in _stretches(batches):
            total += np.concatenate([part.ravel() for part in forward_backward(model, matrix, lengths)])
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells.astype("int32")), pa.array(total[cells])], ["cell", "n"])

    summed = lines.select("symbols").mapInArrow(each, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(states + states * states + states * symbols)
    found = summed.toArrow()
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    start, move, emit = np.split(total, [states, states + states * states])
    return Model(start, move.reshape(states, states), emit.reshape(states, symbols))


def symbol_uses(lex: Lexicon) -> np.ndarray:
    """How often each symbol stands in the rows that were counted: own symbols, then what is left of each class."""
    uses = np.zeros(lex.size)
    for word, i in lex.symbols.items():
        uses[i] = lex.counts.get(word, 0)
    uses[len(lex.symbols) :] = lex.class_uses
    return uses


def train(lines: DataFrame, uses: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of `lines` (symbols); every round is one job over the written table.

    `uses` are the symbols' counts in these rows.

    Documents are cut into stretches, each with its own start, for the passes
    only. Tables are smoothed towards the symbols' overall frequencies, so no
    symbol is impossible in a state.
    """
    frequencies = uses + 0.5
    frequencies /= frequencies.sum()
    model = first_model(frequencies, states)
    for _ in range(rounds):
        found = expected_counts(lines, model)
        start, move = found.start + 1, found.move + 0.1
        emit = found.emit + PRIOR * states * frequencies * 100
        model = Model(
            start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)
        )
    return model


def log10_likelihoods(model: Model, lines: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion over whole symbol rows."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    lengths = np.array([len(lines[i]) for i in order])
    flat = np.concatenate([lines[i] for i in order]) if order else np.empty(0, "uint16")
    begin = np.cumsum(lengths) - lengths
    table = np.ascontiguousarray(model.emit.T)
    logs, now = np.zeros(len(order)), None
    alive = len(order)
    for t in range(int(lengths[0]) if order else 0):
        while lengths[alive - 1] <= t:
            alive -= 1
        now = (model.start if now is None else now[:alive] @ model.move) * table[flat[begin[:alive] + t]]
        total = now.sum(axis=1)
        now = now / total[:, None]
        logs[:alive] += np.log10(total)
    out = np.empty(len(order))
    out[order] = logs
    return out


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rid and forward (log10 likelihood of the symbols) of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(vars(model))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        for batch in batches:
            lines = [np.frombuffer(v.as_buffer(), "<u2") for v in batch.column(1)]
            logs = log10_likelihoods(model, lines)
            yield pa.record_batch([batch.column(0), pa.array(logs)], ["rid", "forward"])

    return rows.select("rid", "symbols").mapInArrow(each, "rid bigint, forward double")


def text_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Both scores are log10 probabilities of a whole text: base_score of its
    words one by one, score by the model. A null or empty text is its end
    alone; rows with a null id are learnt from. Repeated rows count each time.
    Without training rows all words are unseen and the model is uniform.
    """
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    counts = settle(word_counts(rows.where("not held_out")), "word-counts")
    lex = lexicon(counts)
    made = settle(encoded(rows, lex).withColumn("rid", F.monotonically_increasing_id()), "symbols")
    model = train(made.where("not held_out"), symbol_uses(lex), states, rounds)
    spark = docs.sparkSession
    totals = spark.createDataFrame(
        [(i, float(u + w + 1)) for i, (u, w) in enumerate(zip(lex.class_uses, lex.class_words))],
        "class int, whole double",
    )
    whole = float(lex.tokens + lex.words + 1)
    c = F.coalesce("c", F.lit(0))
    rare = (
        made.select("rid", F.explode("rare").alias("r"))
        .select("rid", "r.word", "r.class", "r.n")
        .join(counts.select("word", "c"), "word", "left")
        .join(totals, "class")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((c + 1) / whole)).alias("more_base"),
            F.sum(F.col("n") * F.log10((c + 1) / F.col("whole"))).alias("more_inside"),
        )
    )
    plain = made.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside")
    more = lambda name: F.coalesce(name, F.lit(0))
    return (
        plain.join(scored(made, model), "rid")
        .join(rare, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + more("more_known")).alias("n_known"),
            F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + more("more_base")).alias("base_score"),
            (F.col("forward") + F.col("inside") + more("more_inside")).alias("score"),
        )
    )

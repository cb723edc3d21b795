"""Phrase collocations by weighted acyclic automata.

Texts become shards, one language and up to eight megabytes each, whose word
sequences of up to four words are sorted and built into count automata, one for
every prefix range (a range of a hash of the first two words). The automata of a range are
united by merging, a few hundred at a time, and their prefix weights are the counts of
all phrases in the range. A candidate's parts are looked up in the automata of
the parts' own ranges.

Counts are exact. Filters of a fixed size keep rare sequences out of the automata:
of words, pairs and triples that occur `least` times. They may let a rare one pass,
which its count then drops, and never hold a frequent one back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm import transducers
from scorelens.llm.texts import only, slices
from scorelens.session import settle

LONGEST = 4
LEAST = 30
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
# What ends a piece, and what separates words in one.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
PLAIN = bytes.maketrans(UPPER + PIECE_ENDS + b"\t", LOWER + b"\n" * len(PIECE_ENDS) + b" ")

SHARD_BYTES = 1 << 23
HELD_GRAMS, HELD_WORDS = 1 << 21, 1 << 19
FILTER_BITS = 1 << 26
BITMAP = 1 << 15
GRAMS_PER_RANGE = 1 << 21
WORDS_PER_RANGE = 1 << 20
FAN = 512
TOP_PARTS = 16
SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shard:
    """Texts of one language as word numbers (from 1, in byte order), 0 between pieces and behind the last one."""

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray):
        from xxhash import xxh64_intdigest

        self.lang, self.words, self.ids = lang, words, ids.astype("int64")
        self.width = len(words) + 1
        self.base = xxh64_intdigest(lang.encode(), SEED)

    @classmethod
    def of_texts(cls, lang: str, texts: list[bytes]) -> Shard:
        raw = np.frombuffer(b"\n".join(texts).translate(PLAIN) + b"\n", "uint8")
        line_end = raw == 10
        inside = ~(line_end | (raw == 32))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view("int8")))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype("int64")
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]
        ).dictionary_encode()
        order = pc.array_sort_indices(words.dictionary).to_numpy()
        number = np.empty(len(order) + 1, "int32")
        number[order] = np.arange(1, len(order) + 1)
        piece = np.cumsum(line_end, dtype="int32")[starts]
        new = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)]).astype("int64")[: len(starts)]
        ids = np.zeros(len(starts) + (int(new[-1]) if len(starts) else 0) + 2 * LONGEST, "int32")
        ids[np.arange(len(starts)) + new] = number[words.indices.to_numpy(zero_copy_only=False)]
        return cls(lang, words.dictionary.take(pa.array(order)).to_pylist(), ids)

    def hashes(self) -> np.ndarray:
        """Spark's xxhash64(lang, word) of every word, 0 for the gap before them."""
        from xxhash import xxh64_intdigest

        return np.fromiter((0, *(xxh64_intdigest(w, self.base) for w in self.words)), "uint64", self.width)

    def grams(self, filters: list[np.ndarray]) -> Iterator[Grams]:
        """The runs of 2, 3, ... words whose parts pass the filters of shorter runs, one step per filter."""
        word_hash = self.hashes()
        held = passes(filters[0], word_hash)
        held[0] = False
        here = held[self.ids]
        at = np.flatnonzero(here[:-1] & here[1:])
        # Which word stands first is the run of one word before the pair.
        found = Grams.of(at, self.ids[at], word_hash, self.ids[at + 1], word_hash, self.width)
        yield found
        for longer in filters[1:]:
            good = passes(longer, found.hashes)[found.which]
            at, which = found.at[good], found.which[good]
            stands = np.zeros(len(self.ids), bool)
            stands[at] = True
            size = found.size
            both = stands[at + 1]
            at, which = at[both], which[both]
            found = Grams.of(at, which, found.hashes, self.ids[at + size], word_hash, self.width, size + 1)
            yield found


class Grams:
    """The runs of `size` words at the places `at`: `which` of the different ones, these in word order with `keys` and `hashes`.

    A key is the rank of the run without its last word, times the width, plus the last word.
    """

    def __init__(self, at: np.ndarray, which: np.ndarray, keys: np.ndarray, hashes: np.ndarray, size: int):
        self.at, self.which, self.keys, self.hashes, self.size = at, which, keys, hashes, size

    @classmethod
    def of(cls, at, before, hashes_before, last, word_hash, width, size=2) -> Grams:
        keys, which = np.unique(before * width + last, return_inverse=True)
        mixed = hashes_before[keys // width]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX + word_hash[keys % width]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
        return cls(at, which, keys, mixed ^ (mixed >> np.uint64(29)), size)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes % np.uint64(FILTER_BITS)).astype("int64")
    return (bits[slot >> 3] >> (slot & 7).astype("uint8") & 1).astype(bool)


def shards(batches: Iterable[pa.RecordBatch], size: int = SHARD_BYTES) -> Iterator[Shard]:
    """Shards of (lang, text) batches; of the languages under way the largest goes first, so they never hold more than `size`."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for start, texts in slices(batch):
            for lang, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts):
                held.setdefault(lang, []).append(text or b"")
                sizes[lang] = sizes.get(lang, 0) + len(text or b"") + 1
            while sum(sizes.values()) > size:
                largest = max(sizes, key=sizes.__getitem__)
                del sizes[largest]
                yield Shard.of_texts(largest, held.pop(largest))
    for lang, texts in held.items():
        yield Shard.of_texts(lang, texts)


def texts_of(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return only(docs, "lang", "text").select(lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def bit_filter(slots: DataFrame, slot: Column) -> np.ndarray:
    """A bit map of FILTER_BITS bits from a column of slot numbers; whatever their number, it has this size."""
    found = (
        slots.select(slot.alias("slot"))
        .groupBy(F.expr(f"slot div {BITMAP}").alias("block"))
        .agg(F.bitmap_construct_agg(F.col("slot") % BITMAP).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 8, "uint8")
    for block, part in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        bits[block * BITMAP // 8 : (block + 1) * BITMAP // 8] = np.frombuffer(part, "uint8")
    return bits


def word_counts(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, word, f of all words; the counts of a task's shards are added up before they leave it."""
    names = ["lang", "word", "f"]

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(names[:2]).aggregate([("f", "sum")]).rename_columns(names)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for shard in shards(batches, shard_bytes):
            uses = np.bincount(shard.ids, minlength=shard.width)[1:]
            words = pa.array(shard.words, pa.binary()).cast(pa.string())
            held.append(pa.table([pa.array([shard.lang] * len(words), pa.string()), words, pa.array(uses.astype("int64"))], names))
            if sum(map(len, held)) > HELD_WORDS:
                held = [summed(held)]
                if len(held[0]) > HELD_WORDS // 2:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held = []
        if held:
            yield from summed(held).to_batches(max_chunksize=10_000)

    counted = texts.mapInArrow(each, "lang string, word string, f bigint")
    return settle(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")


def _by_key(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key of the first `width` columns, the rows' other values) of rows that are sorted by the key."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return ((key, (row[width:] for row in group)) for key, group in groupby(rows, key=lambda row: row[:width]))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, ascending, and the sums of their counts; no sum here passes 32 bits."""
    values, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return values, np.bincount(which, np.concatenate([c for _, c in held])).astype("uint32")


def frequent_grams(texts: DataFrame, filters: list, ranges: int, least: int, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """The filter of the next longer runs that occur `least` times, by hash: shards send sorted hashes and counts, one array for each of the ranges."""

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _summed(held)
        part = ((hashes >> np.uint64(32)) % np.uint64(ranges)).astype("int64")
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[r] : cuts[r + 1]]
            yield pa.record_batch(
                [pa.array([r], pa.int64()), pa.array([hashes[mine].tobytes()], pa.binary()), pa.array([counts[mine].tobytes()], pa.binary())],
                ["part", "hashes", "counts"],
            )

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for shard in shards(batches, shard_bytes):
            *_, found = shard.grams([f.value for f in filters])
            held.append((found.hashes, np.bincount(found.which, minlength=len(found.keys)).astype("uint32")))
            if sum(len(h) for h, _ in held) > HELD_GRAMS:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches, 1):
            values, counts = _summed([(np.frombuffer(h, "uint64"), np.frombuffer(c, "uint32")) for h, c in rows])
            slots = (values[counts >= least] % np.uint64(FILTER_BITS)).astype("int64")
            yield pa.record_batch([pa.array(slots)], ["slot"])

    parts = texts.mapInArrow(counted, "part bigint, hashes binary, counts binary").repartition("part").sortWithinPartitions("part")
    return bit_filter(parts.mapInArrow(summed, "slot bigint"), F.col("slot"))


def range_of(lang: Column, first: Column, second: Column, ranges: int) -> Column:
    """The prefix range of a phrase; `second` is '' for single words."""
    return F.pmod(F.xxhash64(lang, first, second), F.lit(ranges))


def shard_automata(shard: Shard, filters: list[np.ndarray], ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, automaton) of the shard: from every place the longest run, of 2 to LONGEST words, whose parts all pass."""
    from xxhash import xxh64_intdigest

    width = shard.width
    found = list(shard.grams(filters[:-1]))
    pairs = found[0]
    good = [passes(f, g.hashes)[g.which] for f, g in zip(filters[1:], found)]
    at, pair = pairs.at[good[0]], pairs.which[good[0]]
    code, levels = pair, []
    for step, (grams, passed) in enumerate(zip(found[1:], good[1:]), 1):
        stands = np.zeros(len(shard.ids) + LONGEST, bool)
        stands[grams.at[passed]] = True
        more = stands[at]
        level, code = np.unique(code * width + np.where(more, shard.ids[at + step + 1], 0), return_inverse=True)
        levels.append(level)
    # The last word needs no filter of its own: both shorter runs in it pass.
    more = more & stands[at + 1]
    level, code = np.unique(code * width + np.where(more, shard.ids[at + LONGEST - 1], 0), return_inverse=True)
    levels.append(level)
    counts = np.bincount(code) if len(code) else np.zeros(0, "int64")
    columns, rank = [], np.arange(len(counts))
    for level in reversed(levels):
        columns.append(level[rank] % width)
        rank = level[rank] // width
    columns += [pairs.keys[rank] % width, pairs.keys[rank] // width]
    named = [b"", *shard.words]
    hashed: dict[int, int] = {}
    for p in np.unique(rank).tolist():
        first, second = divmod(int(pairs.keys[p]), width)
        value = xxh64_intdigest(named[second], xxh64_intdigest(named[first], shard.base))
        hashed[p] = (value - (1 << 64) if value >> 63 else value) % ranges
    part = np.array([hashed[p] for p in rank.tolist()], "int64")
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist() + [len(order)]
    size = sum((c > 0).astype("int64") for c in columns)[order].tolist()
    words = [[named[w] for w in c[order].tolist()] for c in reversed(columns)]
    sequences = [row[:n] for n, row in zip(size, zip(*words))]
    counts, part = counts[order].tolist(), part[order].tolist()
    for low, high in zip(cuts, cuts[1:]):
        yield part[low], transducers.build(zip(sequences[low:high], counts[low:high])).dumps()


def _united(batches: Iterable[pa.RecordBatch], width: int, use: Callable) -> Iterator:
    for key, rows in _by_key(batches, width):
        yield from use(key, transducers.union([transducers.Transducer.loads(blob) for (blob,) in rows]))


def phrase_counts(
    texts: DataFrame, words: DataFrame, total: int, least: int = LEAST, fan: int = FAN, shard_bytes: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame, int]:
    """(lang, phrase, f) of all phrases of two to LONGEST words that occur `least` times; the automata (lang, part, blob); the number of ranges."""
    send = texts.sparkSession.sparkContext.broadcast
    filters = [send(bit_filter(words.where(F.col("f") >= least), _slot(F.xxhash64("lang", "word"))))]
    for _ in range(2, LONGEST):
        filters.append(send(frequent_grams(texts, filters, total // GRAMS_PER_RANGE + 1, least, shard_bytes)))
    ranges = total // WORDS_PER_RANGE + 1

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, shard in enumerate(shards(batches, shard_bytes)):
            name = (TaskContext.get().partitionId() << 32) + number
            for part, blob in shard_automata(shard, [f.value for f in filters], ranges):
                yield pa.record_batch(
                    [pa.array([shard.lang], pa.string()), pa.array([part], pa.int64()), pa.array([name], pa.int64()), pa.array([blob], pa.binary())],
                    ["lang", "part", "shard", "blob"],
                )

    found = settle(texts.mapInArrow(built, "lang string, part bigint, shard bigint, blob binary"), "shard-automata")
    blocks = -(-found.agg(F.count_distinct("shard")).first()[0] // fan)
    key = ["lang", "part", "shard"]
    while blocks > 1:

        def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, part, shard, blob in _united(batches, 3, lambda key, t: [(*key, t.dumps())]):
                yield pa.record_batch([pa.array([lang]), pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], [*key, "blob"])

        dealt = found.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(blocks)))
        dealt = dealt.repartition(*key).sortWithinPartitions(*key)
        found = settle(dealt.mapInArrow(merged, found.schema), "united-automata")
        blocks = -(-blocks // fan)

    def pruned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The frequent phrases of each range, and their automaton; sequences end where their counts say so."""
        for lang, part, phrases in _united(batches, 2, lambda key, t: [(*key, list(t.prefixes(least)))]):
            phrases = [(w, f) for w, f in phrases if len(w) > 1]
            kept = {w: f for w, f in phrases}
            for w, f in phrases:
                if len(w) > 2:
                    kept[w[:-1]] -= f
            blob = transducers.build((w, own) for w, own in sorted(kept.items())).dumps()
            names = pa.array([b" ".join(w) for w, _ in phrases], pa.binary()).cast(pa.string())
            f = pa.array([f for _, f in phrases], pa.int64())
            yield pa.record_batch(
                [pa.array([lang], pa.string()), pa.array([part], pa.int64()), pa.array([blob], pa.binary()), pa.array([None], pa.string()), pa.array([None], pa.int64())],
                ["lang", "part", "blob", "phrase", "f"],
            )
            yield pa.record_batch(
                [pa.array([lang] * len(names), pa.string()), pa.array([part] * len(names), pa.int64()), pa.nulls(len(names), pa.binary()), names, f],
                ["lang", "part", "blob", "phrase", "f"],
            )

    ordered = found.repartition("lang", "part").sortWithinPartitions("lang", "part").select("lang", "part", "blob")
    out = settle(ordered.mapInArrow(pruned, "lang string, part bigint, blob binary, phrase string, f bigint"), "phrases")
    return (
        out.where("phrase IS NOT NULL").select("lang", "phrase", "f"),
        out.where("phrase IS NULL").select("lang", "part", "blob"),
        ranges,
    )


def _slot(value: Column) -> Column:
    """An unsigned hash modulo FILTER_BITS; the low bits of a two's complement number are the same."""
    return value.bitwiseAND(F.lit(FILTER_BITS - 1))


def part_counts(phrases: DataFrame, words: DataFrame, automata: DataFrame, ranges: int) -> DataFrame:
    """lang, phrase, a, k, side, f: how often the first k words (side l) and the rest (side r) of each phrase occur.

    Parts go to the automaton of their range and are looked up as they stream
    past it; single words stand in an automaton of the range's words.
    """
    w = F.split("phrase", " ")
    cut = lambda k, side, part: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("asked"))
    cuts = [
        F.when(F.size(w) > k, F.array(cut(k, "l", F.slice(w, 1, k)), cut(k, "r", F.slice(w, k + 1, LONGEST))))
        for k in range(1, LONGEST)
    ]
    asked = phrases.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.flatten(F.filter(F.array(*cuts), lambda c: c.isNotNull()))))
    second = F.coalesce(F.get("asked", F.lit(1)), F.lit(""))
    asked = asked.withColumn("part", range_of(F.col("lang"), F.get("asked", F.lit(0)), second, ranges))
    names = ["lang", "part", "step", "word", "blob", "phrase", "a", "k", "side", "asked"]

    def shaped(df: DataFrame, step: int) -> DataFrame:
        types = {"word": "string", "blob": "binary", "phrase": "string", "a": "bigint", "k": "int", "side": "string", "asked": "string"}
        have = df.withColumn("step", F.lit(step))
        return have.select(*(F.col(n) if n in have.columns else F.lit(None).cast(types[n]).alias(n) for n in names))

    known = words.select("lang", "word", F.col("f").alias("a"), range_of(F.col("lang"), F.col("word"), F.lit(""), ranges).alias("part"))
    rows = shaped(automata, 0).unionByName(shaped(known, 1))
    rows = rows.unionByName(shaped(asked.withColumn("asked", F.array_join("asked", " ")), 2))
    rows = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "step", "word")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, longer, single, builder = None, None, None, None
        for batch in batches:
            out = []
            for lang, part, step, word, blob, phrase, a, k, side, asked in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, part) != here:
                    here, longer, single, builder = (lang, part), None, None, transducers.Builder()
                if step == 0:
                    longer = transducers.Transducer.loads(blob)
                elif step == 1:
                    builder.add((word.encode(),), a)
                else:
                    single = single or builder.finish()
                    asked = asked.encode().split(b" ")
                    found = single.weight(asked) if len(asked) == 1 else longer.weight(asked) if longer else 0
                    out.append((lang, phrase, a, k, side, found))
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "phrase", "a", "k", "side", "f"), row)) for row in out], answer)

    ddl = "lang string, phrase string, a bigint, k int, side string, f bigint"
    answer = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("k", pa.int32()), ("side", pa.string()), ("f", pa.int64())])
    return rows.mapInArrow(each, ddl)


def collocations(
    docs: DataFrame, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP, fan: int = FAN, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of every language, highest score first.

    Phrases of two to four words within a piece of text that occur `least` times
    or more; of a phrase's cuts the one with the lowest score counts. A phrase is
    left out where a longer candidate holds it and occurs at least
    covered_percent as often. Null texts are empty, null langs are `und`; a table
    without such phrases gives no rows. Further columns are not looked at, and
    repeated rows count as often as they are there.
    """
    texts = texts_of(docs)
    words = word_counts(texts, shard_bytes)
    totals = settle(words.groupBy("lang").agg(F.sum("f").alias("n")), "language-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    phrases, automata, ranges = phrase_counts(texts, words, total, least, fan, shard_bytes)
    parts = part_counts(phrases, words.where(F.col("f") >= least), automata, ranges)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cuts = parts.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r"))
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The phrases inside each longer candidate, with the count of the most frequent one that holds them.
    w = F.split("phrase", " ")
    size = F.size(w)
    spans = [(i, n) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    inside = F.array(*(F.when(size >= max(n + 1, i + n - 1), F.array_join(F.slice(w, i, n), " ")) for i, n in spans))
    held = phrases.where(size > 2).select("lang", F.explode(inside).alias("phrase"), F.col("f").alias("longer"))
    held = held.where(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    covered = held.select("lang", "phrase", "longer").join(scored.select("lang", "phrase", "a"), ["lang", "phrase"])
    covered = covered.where(exact("longer") * 100 >= exact("a") * covered_percent).select("lang", "phrase")
    kept = scored.join(covered, ["lang", "phrase"], "left_anti")
    # The best of a language are among the best of its TOP_PARTS parts, so no task ranks more than TOP_PARTS * top.
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    dealt = kept.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    ranked = dealt.withColumn("rank", best("lang", "dealt")).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", best("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

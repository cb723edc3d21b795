"""Mixing sources to target weights: Sainte-Laguë seats of equal-token blocks, then seeded blocks for the seats.

A source's documents stand in a seeded order and are cut into blocks of `block`
words, whatever the borders of documents; its last block may be shorter. Each
seat of the mix is worth a block. A source with target t claims its seats at the
quotients t, t/3, t/5, ..., and the highest quotients win: all from block / 2
on, which is what the divisor method gives to as many seats as there are then. Shards follow the order of the quotients, shard k ending where the threshold
is total / (2 k shard_blocks), so every shard and every run of first shards has
the quotas that the method gives it. A seeded permutation of the source's blocks
says which block sits on which seat: the first seats take different blocks, the
later ones take them once more.

Only column functions work here. Documents are dealt into ROWS x CELLS cells of
their source; running sums go over the rows of a cell, the cells of a row, and
the rows of a source, so no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.texts import only
from scorelens.session import settle

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST = 2
BLOCK = 32
SHARD_BLOCKS = 1 << 15
SEED = 42
ROWS, CELLS = 256, 256
COPIES = 1000
WORD = "[^\\x20\\x09-\\x0D]+"
# Fixed value: a prime above every count of blocks, so that its remainder shares no factor with the count.
PRIME = 4611686018427387847
MOST_BLOCKS = 1 << 42
HALF = 21

PIECES = "array<struct<shard: bigint, seat: bigint, start: bigint, length: bigint>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _name(source: Column) -> Column:
    """A key that is never null; no name comes after all names."""
    return F.struct(F.isnull(source).alias("none"), F.coalesce(source, F.lit("")).alias("text"))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """The rows with their number (from 0) in the order of a unique key, without a task that sees them all."""
    sorted_rows = df.orderBy(order).withColumn("row_place", F.monotonically_increasing_id())
    rows = settle(sorted_rows, f"numbered-{name}").withColumn("part", F.shiftright("row_place", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row per partition
    starts = counts.select("part", before.alias("before"))
    place = F.col("before") + F.col("row_place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "part").withColumn("place", place).drop("part", "before", "row_place")


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST
) -> DataFrame:
    """source_name, source_size and target (double) from (source_name, source_size), one row per source.

    Targets share share_percent of all sizes by weight; one that would be above
    `most` times its source's size stops there and the others share the rest,
    until none is above. Each round reads one row of sums.
    """
    each = F.array(*(F.lit(int(w)) for w in weights))
    rows = numbered(sources, F.col("source_name"), "sources")
    rows = settle(
        rows.select("source_name", "source_size", F.get(each, (F.col("place") % len(weights)).cast("int")).alias("weight")),
        "weighted-sources",
    )
    size = F.col("source_size").cast("decimal(38,0)")
    total = rows.agg(F.sum(size)).first()[0] or 0
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(float(most))
        full, shared = rows.agg(F.sum(F.when(capped, size)), F.sum(F.when(~capped, F.col("weight")))).first()
        left = int(total) * share_percent - int(full or 0) * most * 100
        last, level = level, left / (100 * int(shared)) if shared else float("inf")
        if level == last or level == float("inf"):
            break
    most_of = F.col("source_size") * F.lit(float(most))
    target = most_of if level == float("inf") else F.least(F.col("weight") * F.lit(level), most_of)
    return rows.select("source_name", "source_size", target.alias("target"))


def seats(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same rows with `full` (whole blocks of the source), `blocks` (a short one counted) and `quota` (seats)."""
    return targets.select(
        "*",
        F.expr(f"source_size div {block}").alias("full"),
        F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"),
        F.floor(F.col("target") / block + 0.5).cast("bigint").alias("quota"),
    )


def _permuted(block: Column, full: Column, shift: Column) -> Column:
    """block -> (PRIME * block + shift) mod full, in two halves, as the product doesn't fit a bigint."""
    n = F.greatest(full, F.lit(1).cast("bigint"))
    factor = F.lit(PRIME) % n
    high = (factor * F.shiftright(block, HALF)) % n
    low = (factor * block.bitwiseAND(F.lit((1 << HALF) - 1))) % n
    return (F.shiftleft(high, HALF) % n + low + shift) % n


def _seed_number(*parts: Column) -> Column:
    """48 bits from the MD5 digest of the parts, colons between."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("bigint")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST,
    block: int = BLOCK,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every row: doc_id, source, digest, size, source_size, target, taken, pieces.

    `pieces` lists (shard, seat, start, length) of the words that a seat of the
    source takes from the text; `taken` adds their lengths up. A source's taken
    words are within 1.5 blocks of its target. Every row of `docs` has one row;
    texts without words, null ones too, have size 0 and no pieces; a table
    without words gives targets of 0. Rows equal in id, source and text stand
    next to each other. Reruns give the same rows, however `docs` is dealt.
    Further columns of `docs` are not looked at.
    """
    if share_percent > 100 * most:
        raise ValueError("the sources don't hold that many words")
    text = F.col("text")
    rows = only(docs, "doc_id", "source", "text").select(
        "doc_id",
        _name(F.col("source")).alias("source_name"),
        word_count(text).alias("size"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"),
    )
    # Equal rows become one with a count, and that chunks, so that no cell is filled by one document's copies.
    key = ["doc_id", "source_name", "size", "digest"]
    alike = rows.groupBy(*key).agg(F.count("*").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}")))
    chunks = alike.select(*key, "n", chunk.alias("chunk")).select(
        *key, "chunk", F.least(F.col("n") - F.col("chunk") * COPIES, F.lit(COPIES)).alias("copies")
    )
    spot = _seed_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"), F.col("chunk").cast("string"), F.lit(str(seed)))
    place = F.struct((F.col("spot") % ROWS).cast("int").alias("row"), (F.expr(f"spot div {ROWS}") % CELLS).cast("int").alias("cell"))
    chunks = settle(chunks.withColumn("spot", spot).select("*", place.alias("at")).select("*", "at.*").drop("at"), "mix-documents")
    words = F.col("size") * F.col("copies")
    cells = settle(chunks.groupBy("source_name", "row", "cell").agg(F.sum(words).alias("words")), "mix-cells")
    cell_rows = settle(cells.groupBy("source_name", "row").agg(F.sum("words").alias("words")), "mix-cell-rows")
    sources = cell_rows.groupBy("source_name").agg(F.sum("words").alias("source_size"))
    plan = settle(seats(targets(sources, weights, share_percent, most), block), "mix-seats")
    largest, total = plan.agg(F.max("blocks"), F.sum(F.col("source_size").cast("decimal(38,0)"))).first()
    if (largest or 0) >= MOST_BLOCKS:
        raise ValueError(f"a source of {largest} blocks is too large; take longer blocks")
    all_targets = int(total or 0) * share_percent / 100

    def before(value: Column, by: list[str], *order: str) -> Column:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(window), F.lit(0).cast("bigint"))

    row_starts = cell_rows.withColumn("row_start", before(F.col("words"), ["source_name"], "row")).drop("words")
    started = (
        cells.withColumn("in_row", before(F.col("words"), ["source_name", "row"], "cell"))
        .drop("words")
        .join(row_starts.join(plan, "source_name"), ["source_name", "row"])
    )
    placed = chunks.withColumn("in_cell", before(words, ["source_name", "row", "cell"], "spot", "digest", "doc_id", "chunk"))
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
    placed = placed.join(started, ["source_name", "row", "cell"]).select("*", copy)
    start = F.col("row_start") + F.col("in_row") + F.col("in_cell") + F.col("copy") * F.col("size")
    name = F.when(~F.col("source_name.none"), F.col("source_name.text"))
    shift = _seed_number(F.lit("blocks"), F.col("source_name.text"), F.lit(str(seed))) % F.greatest("full", F.lit(1).cast("bigint"))
    placed = placed.select(
        "doc_id", name.alias("source"), "digest", "size", "source_size", "target", "full", "blocks", "quota",
        start.alias("start"), shift.alias("shift"),
    )

    def on_seat(number: Column) -> Column:
        """The piece of the document in a block of its source, with the block's first seat."""
        first = F.when(number < F.col("full"), _permuted(number, F.col("full"), F.col("shift"))).otherwise(F.col("full"))
        begin = F.greatest(number * block, F.col("start"))
        end = F.least((number + 1) * block, F.col("start") + F.col("size"))
        return F.struct(first.alias("seat"), (begin - F.col("start")).alias("start"), (end - begin).alias("length"))

    met = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    first = F.when(F.col("size") > 0, F.filter(F.transform(met, on_seat), lambda p: p["seat"] < F.col("quota")))
    placed = placed.withColumn("first", first)
    again = F.transform(
        F.filter("first", lambda p: p["seat"] + F.col("blocks") < F.col("quota")),
        lambda p: F.struct((p["seat"] + F.col("blocks")).alias("seat"), p["start"].alias("start"), p["length"].alias("length")),
    )
    shard = lambda s: F.floor((2 * s + 1) * F.lit(all_targets / (2 * shard_blocks)) / F.col("target"))
    pieces = F.transform(
        F.coalesce(F.concat("first", again), F.array().cast("array<struct<seat: bigint, start: bigint, length: bigint>>")),
        lambda p: F.struct(shard(p["seat"]).cast("bigint").alias("shard"), p["seat"].alias("seat"), p["start"].alias("start"), p["length"].alias("length")),
    )
    placed = placed.withColumn("pieces", pieces.cast(PIECES))
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["length"])
    return placed.select("doc_id", "source", "digest", "size", "source_size", "target", taken.alias("taken"), "pieces")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, source, seat, doc_id, start, text; one row per piece, words one space apart.

    The blocks of a seat follow each other by `start` within a document. Write
    it by `shard`; the order of `seat` within a shard is the seeded one.
    """
    pieces = mix(docs, **options).select("doc_id", "source", "digest", F.inline("pieces"))
    texts = only(docs, "doc_id", "source", "text").where(F.col("text").isNotNull())
    digest = F.md5(F.col("text").cast("binary"))
    texts = texts.select("doc_id", "source", digest.alias("digest"), F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"))
    texts = texts.dropDuplicates(["doc_id", "source", "digest"])
    same = lambda c: pieces[c].eqNullSafe(texts[c])
    text = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ")
    joined = pieces.join(texts, same("doc_id") & same("source") & same("digest"))
    return joined.select("shard", pieces["source"], "seat", pieces["doc_id"], "start", text.alias("text"))

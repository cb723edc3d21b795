"""SimHash near-duplicates: pigeonhole blocks over fingerprints, Hamming check, components.

Fingerprints of 64 bits are cut into four blocks of 16. Two that differ in at
most two bits agree in two blocks at least, so each is filed under its six
pairs of blocks and met only by those it shares a pair with. A file that holds
more fingerprints than FILE is not paired up: there, each fingerprint also goes
under all values one bit away in the open blocks, and those that meet under a
value differ in at most two bits, which is the same condition. Links are
between different fingerprints, equal ones are one node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.components import components
from scorelens.llm.texts import only, slices
from scorelens.session import settle

SHINGLE = 3
BITS = 2
SEED = 42
FILE = 64
BLOCKS = [0xFFFF << (16 * i) for i in range(4)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def bit_majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.uint64(0x0101010101010101)
    out = 0
    padded = np.zeros(-(-n // 255) * 255, "uint64")
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    for shift in range(8):
        # Eight counters in the bytes of a word; 255 summands can't overflow them.
        sums = ((padded >> np.uint64(shift)) & lanes).sum(axis=1, dtype="uint64")
        counts = sums.view("uint8").reshape(-1, 8).sum(axis=0, dtype="int64")
        for byte in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * byte + shift)
    return out


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)]
    return bit_majority(np.array(hashes, "uint64"))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, digest (a hash of the text) and fp (the fingerprint as a bigint) per row; fp 0 for texts without words."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(fingerprint(t, size)) for _, texts in slices(batch) for t in texts]
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(made, pa.int64())], ["doc_id", "digest", "fp"]
            )

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(each, "doc_id bigint, digest bigint, fp bigint")


def fingerprint_links(fps: DataFrame, file: int = FILE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at 2 or fewer differing bits, or a star over such pairs.

    `fps` has distinct fp and is a written table. Fingerprints in an over-full
    file are linked to the smallest that shares a one-bit neighbour with them.
    """
    pairs = list(combinations(range(4), 2))
    masks = [_signed(BLOCKS[i] | BLOCKS[j]) for i, j in pairs]
    filed = fps.select(
        "fp",
        F.explode(
            F.array(
                *(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks))
            )
        ).alias("file"),
    ).select("fp", "file.part", "file.bits")
    sizes = settle(filed.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1"), "file-sizes")
    met = filed.join(sizes, ["part", "bits"])
    few = met.where(F.col("n") <= file)
    other = few.select("part", "bits", F.col("fp").alias("b"))
    checked = (
        few.select("part", "bits", F.col("fp").alias("a"))
        .join(other, ["part", "bits"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))
        .select("a", "b")
    )
    open_bits = [[b for i in range(4) if i not in pair for b in range(16 * i, 16 * i + 16)] for pair in pairs]
    flips = F.array(*(F.array(F.lit(0), *(F.lit(_signed(1 << b)) for b in bits)).cast("array<bigint>") for bits in open_bits))
    near = (
        met.where(F.col("n") > file)
        .select("part", "fp", F.explode(F.get(flips, F.col("part"))).alias("flip"))
        .select("part", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    )
    hubs = near.groupBy("part", "near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(hubs, ["part", "near"]).where("fp != a").select("a", F.col("fp").alias("b"))
    return checked.unionByName(stars).distinct()


def _rooted(fps: DataFrame) -> DataFrame:
    """The columns of `fps` (a written table of distinct fp) and root, the name of each fingerprint's component."""
    roots = settle(components(fingerprint_links(fps.select("fp"))), "roots")
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs`.

    component_id is the smallest doc_id that links reach, own included. Null
    doc_ids are kept and never name a component that has another id; null or
    empty texts have fingerprint 0. Repeated rows are repeated in the result.
    """
    rows = settle(fingerprints(docs, size), "fingerprints")
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    named = _rooted(fps)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each component of near-duplicates, columns unchanged.

    The smallest doc_id stays; a null one only where there is no other, and of
    several texts under that id the one with the smallest hash. Of rows equal
    in id and text one stays. Texts without words are duplicates of each other.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    rows = settle(fingerprints(docs, size), "fingerprints")
    fps = settle(rows.groupBy("fp").agg(first.alias("least")), "distinct-fingerprints")
    least = _rooted(fps).groupBy("root").agg(F.min("least").alias("least"))
    place = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    stay = least.select(place(F.col("least.doc_id")).alias("keep_place"), F.col("least.digest").alias("keep_digest"))
    marked = docs.select(
        F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"),
        place(F.col("doc_id").cast("bigint")).alias("keep_place"),
        F.xxhash64("text").alias("keep_digest"),
    )
    kept = marked.join(stay, ["keep_place", "keep_digest"]).dropDuplicates(["keep_place", "keep_digest"])
    return kept.select(*(F.col("row").getField(n).alias(n) for n in docs.columns))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

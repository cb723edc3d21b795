"""Shuffled shards by a two-pass external shuffle.

Pass one scatters rows by a seeded hash into buckets that fit a worker's
memory; pass two puts each bucket into a seeded Fisher-Yates order. Buckets in
a row are one random order of all rows, which is cut into shards of equal row
counts and written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.session import fresh_path, settle

SHARDS = 8
SEED = 42
BUCKET_BYTES = 16 << 20
COPIES = 1000
CELL = 4096
OWN = ("shard", "slot", "shuffle_bucket", "shuffle_before", "shuffle_crc", "shuffle_size", "shuffle_copy", "shuffle_at")


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0)) + 1


def _text_crc(text: Column) -> Column:
    return F.coalesce(F.crc32(text), F.lit(0))


def _in_seeded_order(names: list[str], seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def shuffle(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        # Rows arrive in any order; a fixed one first makes the result repeatable.
        rows = rows.sort_by([(n, "ascending") for n in ("doc_id", "shuffle_crc", "shuffle_size", "shuffle_copy")])
        # Generator.permutation is a Fisher-Yates shuffle.
        order = np.random.Generator(np.random.Philox(key=[seed, bucket])).permutation(rows.num_rows)
        rows = rows.take(pa.array(order))
        at = rows.column("shuffle_before").to_numpy() + np.arange(rows.num_rows)
        return rows.select(names).append_column("shuffle_at", pa.array(at, pa.int64()))

    return shuffle


def _starts(sizes: DataFrame) -> DataFrame:
    """Each bucket with the number of rows in the buckets before it, from `sizes` (shuffle_bucket, n), a written table.

    Sums run inside cells of CELL buckets and over the cells, of which there is
    one for 64 gigabytes of text.
    """
    cell = F.floor(F.col("shuffle_bucket") / CELL).alias("cell")
    before = F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = sizes.groupBy(cell).agg(F.sum("n").alias("n")).select("cell", before.alias("cells_before"))
    inside = Window.partitionBy("cell").orderBy("shuffle_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("cell", F.floor(F.col("shuffle_bucket") / CELL))
        .withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(cells, "cell")
        .select("shuffle_bucket", (F.col("cells_before") + F.col("inside")).alias("shuffle_before"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write all rows to Parquet below `path`, by shard, with their slot in it (gapless from 0).

    Shard sizes differ by one row at most. Buckets come from doc_id and text,
    so copies of a text under other ids are scattered; null ids and texts hash
    like values. Where more than COPIES rows are equal in both, every row gets
    a number that is written with it and hashed as well, so they scatter too;
    the order then depends on how the table is partitioned, else on the seed
    alone. Columns of `docs` that bear the names shard, slot or those of OWN
    are left out. An empty table gives an empty one.
    """
    names = [n for n in docs.columns if n not in OWN]
    text = F.col("text")
    marked = docs.select(*(F.col(f"`{n}`") for n in names)).select(
        "*", _text_crc(text).alias("shuffle_crc"), _bytes(text).alias("shuffle_size"), F.lit(0).alias("shuffle_copy")
    )
    equal = ["doc_id", "shuffle_crc", "shuffle_size", "shuffle_copy"]
    counts = settle(marked.groupBy(*equal).agg(F.count("*").alias("n")), "row-counts")
    sums = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("shuffle_size")), F.max("n")).first()
    rows, total, most = (v or 0 for v in sums)
    if most > COPIES:
        marked = settle(marked.withColumn("shuffle_copy", F.monotonically_increasing_id()), "numbered")
        counts = marked.select(*equal, F.lit(1).alias("n"))
    buckets = max(1, -(-total // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *equal), F.lit(buckets)).alias("shuffle_bucket")
    sizes = settle(counts.groupBy(bucket).agg(F.sum("n").alias("n")), "bucket-sizes")
    at = settle(_starts(sizes), "bucket-starts")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    position = F.col("shuffle_at")
    shard = F.expr(f"int(shuffle_at * {shards} div {max(rows, 1)})")
    first = F.expr(f"(bigint(shard) * {rows} + {shards - 1}) div {shards}")
    (
        marked.select("*", bucket)
        .join(at, "shuffle_bucket")
        .groupBy("shuffle_bucket")
        .applyInArrow(_in_seeded_order(names, seed), f"{kept}, shuffle_at bigint")
        .withColumn("shard", shard)
        .withColumn("slot", position - first)
        .drop("shuffle_at")
        .write.partitionBy("shard")
        .parquet(path)
    )


def shard_digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write the shards to the shared folder and describe every row from what was written."""
    path = fresh_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed)
    read = docs.sparkSession.read.schema("doc_id bigint, text string, slot bigint, shard int").parquet(path)
    return read.select(
        "doc_id",
        _bytes(F.col("text")).alias("size"),
        _text_crc(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

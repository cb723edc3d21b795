"""Comment and lexicon readers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scorelens.operators.lexicon import last_of_each_word
from scorelens.session import settle

# The columns of the comment table, all text.
COMMENT_COLUMNS = (
    "body",
    "author",
    "created_utc",
    "subreddit_id",
    "link_id",
    "parent_id",
    "score",
    "retrieved_on",
    "controversiality",
    "gilded",
    "id",
    "subreddit",
    "ups",
)
COMMENT_SCHEMA = StructType([StructField(name, StringType()) for name in COMMENT_COLUMNS])


def read_json_comments(spark: SparkSession, path: str, schema=COMMENT_SCHEMA) -> DataFrame:
    """JSON lines from any file system Spark knows; no pass to infer a schema."""
    return spark.read.schema(schema).json(path)


def read_csv_comments(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; quoted bodies may hold line ends and doubled quotes. All columns are text.

    Splits of a file are read side by side, so one large file is many tasks'
    work: a line ends a record where the quotes up to it are even in number,
    and how many stand before a split follows from the splits' own counts. The
    lines of a record then meet, wherever the splits cut. The columns are those of
    the first file's header; every file begins with one. Empty lines between records are no rows.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    # Written, as another reading may cut the files elsewhere and number the lines otherwise.
    lines = settle(lines, "csv-lines")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    splits = lines.groupBy("file", "split").agg(F.sum(quotes).alias("quotes"), F.min("line").alias("first"))
    # One row per split of a file.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = settle(splits.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0))), "csv-splits")
    in_split = Window.partitionBy("file", "split").orderBy("line")
    placed = lines.join(splits.select("file", "split", "open"), ["file", "split"])
    placed = placed.withColumn("inside", (F.col("open") + F.sum(quotes).over(in_split)) % 2)
    # A record is named by the line that ends it, or by the split's end where none does.
    ends = F.when(F.col("inside") == 0, F.col("line"))
    # From the back: a frame that reaches to the last row is gone through anew for every row.
    ahead = Window.partitionBy("file", "split").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = placed.withColumn("end", F.min(ends).over(ahead))
    # What a split leaves open goes on to the first end in a later one.
    first_end = named.groupBy("file", "split").agg(F.min(ends).alias("first_end"))
    later = Window.partitionBy("file").orderBy(F.desc("split")).rowsBetween(Window.unboundedPreceding, -1)
    going_on = first_end.withColumn("next_end", F.last("first_end", ignorenulls=True).over(later))
    going_on = settle(going_on.select("file", "split", "next_end"), "csv-open-records")
    named = named.join(going_on, ["file", "split"]).withColumn("end", F.coalesce("end", "next_end", F.lit(-1)))
    records = named.groupBy("file", "end").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("split", "line", "value"))).getField("value"), "\n").alias("record"),
        F.min(F.struct("split", "line")).alias("place"),
    )
    heads = splits.groupBy("file").agg(F.min_by("first", "split").alias("head_line"))
    header_line = lines.join(heads, "file").where(F.col("line") == F.col("head_line")).orderBy("file").select("value").first()
    names = [] if header_line is None else next(csv.reader([header_line["value"].removesuffix("\r")]), [])
    rows = records.join(heads, "file").where((F.col("place.line") != F.col("head_line")) & (F.trim("record", F.lit("\r")) != ""))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
    return rows.select(F.from_csv("record", _ddl(names), options).alias("row")).select("row.*")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)


def read_table_comments(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet comment table, brought to the thirteen text columns."""
    return as_comment_table(spark.read.parquet(path))


def as_comment_table(df: DataFrame) -> DataFrame:
    """The thirteen text columns; a column the frame lacks is null."""
    present = {name.lower(): name for name in df.columns}
    return df.select(
        *[
            (F.col(present[name]) if name in present else F.lit(None)).cast("string").alias(name)
            for name in COMMENT_COLUMNS
        ]
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """`word<TAB>valence` lines, one row per word.

    Lines of other field counts and valences that are no whole numbers are
    skipped; a repeated word's last line wins.
    """
    lines = spark.read.text(path).select(
        F.split("value", "\t").alias("fields"),
        F.struct(
            "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
        ).alias("place"),
    )
    entries = lines.where(F.size("fields") == 2).select(
        F.col("fields")[0].alias("word"), F.col("fields")[1].try_cast("int").alias("valence"), "place"
    )
    return last_of_each_word(entries.where(F.col("valence").isNotNull()), "place")


def lexicon_frame(spark: SparkSession, valences: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(valences.items()), "word string, valence int")

"""Vectors as rows of (slot, value)."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scorelens.session import write_once

SPARSE = 0


def nonzero_slots(vector: str) -> Column:
    """array<struct<slot, value>> of a vector column, sparse or dense, zeros left out."""
    parts = F.unwrap_udt(F.col(vector))
    pair = "array<struct<slot:int,value:double>>"
    sparse = F.arrays_zip(parts["indices"], parts["values"]).cast(pair)
    dense = F.transform(parts["values"], lambda value, slot: F.struct(slot, value)).cast(pair)
    slots = F.when(parts["type"] == SPARSE, sparse).otherwise(dense)
    return F.filter(slots, lambda entry: entry["value"] != 0)


def sparse_vector(size: Column, slots: Column, values: Column) -> Column:
    """What a sparse vector is stored as, from its slots in order and their values; see `settled_vectors`."""
    return F.struct(
        F.lit(SPARSE).cast("tinyint").alias("type"),
        size.cast("int").alias("size"),
        slots.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )


def settled_vectors(df: DataFrame, vector: str, name: str) -> DataFrame:
    """A written copy of the frame whose column of `sparse_vector` is read back as a column of vectors."""
    fields = [StructField(vector, VectorUDT()) if f.name == vector else f for f in df.schema]
    return df.sparkSession.read.schema(StructType(fields)).parquet(write_once(df, name))

"""What the corpus operators share: tables, labels, shared-folder writes and Arrow batches.

Every operator reads only the columns it names, so extra columns with clashing names pass by it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python turns so many rows of an Arrow batch into objects at a time, whatever the batch's size.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a single machine (local mode, as in tests)
    takes a temporary one; on a cluster, whose machines would each see another folder, that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="matchlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, so a lost executor repeats none of it.
    Tables of one application are in one folder, matchlake-<application id>, which can go when the application has ended."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/matchlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n: which fold a row is in."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def rows_to_arrow(schema: T.StructType | str, columns: list[str], rows_of: Callable[..., Iterator[tuple]]) -> Callable:
    """For mapInArrow: rows_of gets lists, one for each of columns, ROWS_AT_ONCE values at most, and yields output rows."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, kinds = schema.names, [{"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()] for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in columns]
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = list(rows_of(*(part.column(i).to_pylist() for i in at)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def map_texts(df: DataFrame, columns: list[str], schema: str, rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """rows_of over the named columns of df, in Arrow batches; see rows_to_arrow."""
    return df.select(*columns).mapInArrow(rows_to_arrow(schema, columns, rows_of), schema)


def parts_of(text: Column, doc_id: Column, parts: int, chars: int | Column) -> Column:
    """A text of up to parts * chars characters whole; of a longer one so many parts of so many characters, at hashed places."""
    n, chars = F.length(text), F.lit(chars) if isinstance(chars, int) else chars
    places = [F.pmod(F.xxhash64(doc_id, F.lit(i)), (n - chars).cast("long")).cast("int") + 1 for i in range(parts)]
    return F.when(n <= chars * parts, text).otherwise(F.concat_ws(" ", *(F.substring(text, p, chars) for p in places)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int | None, per_class: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample: per_class documents of each label 0 and 1, in the order of a hash of doc_id,
    without those whose fold is held_out (None: all folds). Null labels don't count, and only labels of rows that docs still has.
    A doc_id on several rows has several here."""
    ok = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    if held_out is not None:
        ok = ok.where(fold("doc_id", folds) != held_out)
    ok = stored(ok.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    ids = [ok.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for label in (0, 1)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # ids: 2 * per_class rows at most

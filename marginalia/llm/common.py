"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold at most this many documents, or bytes where Spark knows that limit.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"  # for a SQL string literal
SPACE = b" \t\n\x0b\x0c\r"


def batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    except Exception as e:  # an older Spark has no such setting
        if "CANNOT_MODIFY" not in str(e) and "maxBytesPerBatch" not in str(e):
            raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: later steps neither repeat its work nor depend on its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of more rows than this, and than 1/10,000 of all, are joined apart from the others.
HOT_ROWS = 50_000


def most_rows(n: int) -> int:
    """Keys with more of n rows than this, fewer than 10,000 keys, are hot."""
    return max(HOT_ROWS, n // 10_000)


def join_hot(big: DataFrame, small: DataFrame, on: list[str], weight: str) -> DataFrame:
    """big, stored, joined to small, stored and unique on its keys; weight: small's column with the number of big's rows a key.

    Hot keys, at most 10,000 as each holds more than 1/10,000 of big's rows, go to big as a broadcast table; the others shuffle. So no task
    gets more than that share of the rows, however skewed the keys.
    """
    most = most_rows(big.count())
    hot = small.where(F.col(weight) > most)
    if hot.isEmpty():
        return big.join(small, on)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(weight) <= most), on)
    return cold.unionByName(big.join(F.broadcast(hot), on))


def identity(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row; rows that agree in both are equal."""
    whole = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64(F.lit(i), *whole).alias(f"_d{i}") for i in (1, 2)]


def map_docs(docs: DataFrame, columns: list[str], each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """each() over Arrow batches of the named columns; rows may change in number. No shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield each(b)

    return docs.select(*columns).mapInArrow(run, schema)


def as_bytes(b: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 texts; null counts as empty."""
    return [x or b"" for x in b.column(name).cast(pa.binary()).to_pylist()]


def as_str(b: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in b.column(name).to_pylist()]


def n_words(col: str = "text"):
    """Number of words between ASCII white space; null: 0."""
    return F.expr(f"coalesce(regexp_count({col}, '{WORD}'), 0)").cast("long")


def tokenizer_path(path: str | None = None) -> str:
    """The byte-level BPE vocabulary; a file of the public_tokenizers package unless a path is given."""
    if path:
        return path
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))

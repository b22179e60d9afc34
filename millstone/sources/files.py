"""A folder of text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path) of every file of a folder, a document a file.

    An id is the hash of the file's name in the folder, positive, so it stays the same when files come or go.
    """
    found = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("path"))
    return found.select((F.xxhash64("path").bitwiseAND(F.lit((1 << 62) - 1)) + 1).alias("doc_id"), "text", "path")

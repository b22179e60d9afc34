"""Approximate term matching by edit distance over UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 2


def _bytes(c: Column) -> Column:
    """One character for each byte, so that character distance is byte distance."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column, limit: int | None = None) -> Column:
    """Edit distance in bytes; -1 above ``limit``, where one is given."""
    return F.levenshtein(_bytes(a), _bytes(b)) if limit is None else F.levenshtein(_bytes(a), _bytes(b), limit)


def candidates(values: list[str], terms: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(value, term, total, distance) of all used terms within the tolerance of each value of a query.

    The values are constants of a narrow pass over the terms; the length band is tested before the distance.
    """
    if not values:
        return terms.select(F.lit("").alias("value"), "term", "total", F.lit(0).alias("distance")).limit(0)
    near = F.abs(F.octet_length("value") - F.octet_length("term")) <= tolerance
    return (
        terms.where(F.col("total") > 0)
        .select(F.explode(F.array(*[F.lit(v) for v in values])).alias("value"), "term", "total")
        .where(near)
        .withColumn("distance", byte_levenshtein(F.col("value"), F.col("term"), tolerance))
        .where(F.col("distance") >= 0)
    )


def best(found: DataFrame) -> DataFrame:
    """(value, term): the most frequent candidate of each value, the first in order among equals."""
    rank = F.row_number().over(W.partitionBy("value").orderBy(F.desc("total"), "term"))
    return found.withColumn("rank", rank).where("rank = 1").select("value", "term")

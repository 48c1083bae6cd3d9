"""Equi-joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
#: The 512 most frequent keys include every key with more than 1/512 of the rows; further ones need no spreading.
MAX_HOT_KEYS = 512
MAX_SALTS = 1024


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> dict[object, int]:
    """Frequent keys with their row counts. Counts are combined before the shuffle, at most 512 keys come back."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    rows = counts.where(F.col("_rows") > hot_rows).orderBy(F.desc("_rows")).limit(MAX_HOT_KEYS).collect()
    return {row[key]: row["_rows"] for row in rows}


def _salt_count(key: Column, hot: dict[object, int], hot_rows: int) -> Column:
    """Number of salts of a key: 1 unless it is hot."""
    by_salts: dict[int, list] = {}
    for value, rows in hot.items():
        by_salts.setdefault(min(MAX_SALTS, 2 ** (rows // hot_rows).bit_length()), []).append(value)
    salts = F.lit(1)
    for n, values in by_salts.items():
        salts = F.when(key.isin(*values), n).otherwise(salts)
    return salts


def splits_skew(spark: SparkSession) -> bool:
    """Whether adaptive execution splits oversized join partitions of this session by itself."""
    settings = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(str(spark.conf.get(s, "true")).lower() == "true" for s in settings)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    *,
    spread_by: str,
    hot_rows: int | None = None,
    null_salts: int = 64,
) -> DataFrame:
    """``left.join(right, key, how)`` for inner, left and semi joins whose left side may have hot or missing keys.

    Adaptive execution splits the partition of a hot key, or of the missing keys, at run time from the sizes it sees,
    without another pass. Where it is off, or ``hot_rows`` is given, hot keys are counted first: their left rows are
    dealt over salts by the hash of ``spread_by``, only the matching right rows are repeated, and rows without a key
    are dealt evenly. The result is the same.
    """
    if hot_rows is None and splits_skew(left.sparkSession):
        return left.join(right, key, how)
    hot_rows = hot_rows or HOT_ROWS
    hot = hot_keys(left, key, hot_rows)
    spread = F.xxhash64(spread_by)
    salts = F.when(F.col(key).isNull(), null_salts).otherwise(_salt_count(F.col(key), hot, hot_rows))
    salted_left = left.withColumn("_salt", F.pmod(spread, salts.cast("long")).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), _salt_count(F.col(key), hot, hot_rows) - 1)) if hot else F.lit(0)
    salted_right = right.where(F.col(key).isNotNull()).withColumn("_salt", copies)
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")

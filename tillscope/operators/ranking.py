"""Exact ranks, running totals and percentiles without sorting a whole group in one task.

Values are first placed in order-preserving buckets (any non-decreasing function of the value will
do), by their logarithm. A bucket that holds more rows than a task's share is cut into equal parts
between its own smallest and largest value, and this is repeated until none does, so the buckets
follow the data. The bucket totals are a small table, so the running total over buckets is cheap;
what is left is a running total inside each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.session import materialize

# Bucket width: 1/256 of a natural-log unit above one millionth, so about 0.4 % of the value.
_SMALLEST, _PER_LOG_UNIT = 1e6, 256
# Rows that a bucket may hold in any case, buckets that a task's share of the rows is cut into, parts of a bucket in one round.
BUCKET_ROWS, PER_TASK, MOST_PARTS = 10_000, 4, 1_024


def bucket_of(value: Column) -> Column:
    """A non-decreasing function of the value with at most a few hundred thousand results."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * _SMALLEST) * _PER_LOG_UNIT).cast("long")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality over the named columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with nulls equal; the keys appear once.

    Without keys ``right`` is a table per scope, and without scope columns that is a single row.
    """
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    if how in ("full", "right"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(k, f"__r_{k}"))
    return joined.drop(*[f"__r_{k}" for k in keys])


# Bytes of a side table that every executor may hold, counted as its texts and a row's share of a hash table.
SENT_BYTES, _ROW_BYTES = 64 * 1024 * 1024, 64


def is_small(table: DataFrame) -> bool:
    """Whether ``table`` (written) is small enough to be sent to every executor, however many rows it meets."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"]
    return (table.agg(F.sum(sum(texts, F.lit(_ROW_BYTES)))).first()[0] or 0) <= SENT_BYTES


def sent(table: DataFrame) -> DataFrame:
    """``table`` (written) with the hint to broadcast it if it is small: its bytes are counted, not guessed from compressed files."""
    return F.broadcast(table) if is_small(table) else table


def bucketed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``df`` (written) with ``__bucket``, an array whose order is that of the values; one row per group and value.

    A bucket holds at most a quarter of what a shuffle partition gets when rows are dealt evenly, or ``BUCKET_ROWS``. Parts of
    a bucket are cut in double precision: of values that are one double none is told from another, and they stay together.
    """
    number = F.col(value).cast("double")
    df = materialize(df, "ranked").withColumn("__bucket", F.array(bucket_of(F.col(value))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        sizes = df.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"), F.min(number).alias("__low"), F.max(number).alias("__high"))
        can = F.col("__low") < F.col("__high")
        seen = sizes.agg(F.sum("__n").alias("rows"), F.max(F.when(can, F.col("__n"))).alias("most")).first()
        bound = max(BUCKET_ROWS, (seen.rows or 0) // (PER_TASK * tasks))
        if (seen.most or 0) <= bound:
            return df
        parts = F.least(F.ceil(F.col("__n") * 2 / bound), F.lit(MOST_PARTS))
        crowded = materialize(sizes.where(can & (F.col("__n") > bound)).select(*group, "__bucket", "__low", "__high", parts.alias("__parts")), "crowded")
        # The share of the way from low to high never falls as the value rises, whatever doubles round.
        part = F.least(F.floor((number - F.col("__low")) / (F.col("__high") - F.col("__low")) * F.col("__parts")), F.col("__parts") - 1).cast("long")
        df = join_same(df, crowded, [*group, "__bucket"], "left")
        df = df.withColumn("__bucket", F.when(F.col("__parts").isNotNull(), F.concat("__bucket", F.array(part))).otherwise(F.col("__bucket")))
        df = materialize(df.drop("__low", "__high", "__parts"), "ranked")


def with_running_total(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Add ``before`` (total weight of lower values in the group) and ``total`` (of the whole group).

    ``df`` has one row per group and value.
    """
    keyed = bucketed(df, group, value)
    order = W.partitionBy(*group).orderBy("__bucket")
    buckets = (
        keyed.groupBy(*group, "__bucket").agg(F.sum(weight).alias("__w"))
        .withColumn("__below", F.coalesce(F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("__w").over(W.partitionBy(*group)))
        .drop("__w")
    )
    inside = W.partitionBy(*group, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        join_same(keyed, buckets, [*group, "__bucket"])
        .withColumn("before", F.col("__below") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("__bucket", "__below")
    )


def percentiles(
    counts: DataFrame, group: list[str], value: str, weight: str, wanted: dict[str, float]
) -> DataFrame:
    """Exact percentiles by linear interpolation; one row per group, one column per name in ``wanted``.

    ``counts`` holds one row per group and value, ``weight`` how often it occurs.
    """
    ranked = with_running_total(counts, group, value, weight)
    n = F.col("total")
    upto = F.col("before") + F.col(weight)
    picks = []
    for name, share in wanted.items():
        position = (n - 1) * F.lit(share)
        for part, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("before") <= at) & (at < upto)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{part}"))
    found = ranked.groupBy(*group).agg(F.max("total").alias("__n"), *picks)
    out = []
    for name, share in wanted.items():
        position = (F.col("__n") - 1) * F.lit(share)
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*group, *out)


def quintiles(counts: DataFrame, group: list[str], value: str, weight: str, ascending: bool = True) -> DataFrame:
    """Five equal-rank bins over the members, tied values sharing their mean bin (a half rounds down).

    ``counts`` holds one row per group and value with the number of members; the result adds
    ``score`` 1–5, 5 for the best (largest when ascending, smallest otherwise); one member scores 5.
    """
    signed = counts.withColumn("__v", F.col(value) if ascending else -F.col(value))
    ranked = with_running_total(signed, group, "__v", weight)
    n, first, last = F.col("total"), F.col("before") + 1, F.col("before") + F.col(weight)

    # Positions p with bin(p) = max(1, ceil(5(p-1)/(n-1))) at most b are those up to floor(b(n-1)/5)+1.
    def below(bound: int) -> Column:
        edge = F.floor(F.lit(bound) * (n - 1) / 5) + 1
        return F.greatest(F.lit(0), F.least(last, edge) - first + 1)

    # The sum of bins is 5 for every position less one for each bin edge the position is at or under.
    total_bins = 5 * F.col(weight) - sum((below(b) for b in (1, 2, 3, 4)), F.lit(0))
    mean = total_bins / F.col(weight)
    score = F.when(n == 1, 5).otherwise(F.ceil(mean - 0.5)).cast("int")
    return ranked.withColumn("score", score).drop("__v", "before", "total")


def share_reached(counts: DataFrame, group: list[str], value: str, weight: str, share: float) -> DataFrame:
    """Fewest members, largest first, whose values sum to ``share`` of the group's total.

    ``counts`` holds one row per group and positive value with the number of members.
    """
    money = counts.withColumn("__neg", -F.col(value)).withColumn("__money", F.col(value) * F.col(weight))
    ranked = with_running_total(money, group, "__neg", "__money")
    bound = F.col("total") * F.lit(share)
    short = F.ceil((bound - F.col("before")) / F.col(value)) - 1
    under = F.greatest(F.lit(0), F.least(F.col(weight), short))
    return ranked.groupBy(*group).agg(
        F.least(F.sum(under) + 1, F.sum(weight)).cast("long").alias("needed"), F.sum(weight).cast("long").alias("members")
    )

"""Seeded samples, top-n and row numbers that no single task has to carry.

A seeded order is the order of ``md5(seed:key)``. Keys must be unique in their table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlens.sources.tables import stored

HASH_BUCKETS = 16**4
SAMPLED_KEYS = 4096
BROADCAST_ROWS = 200_000


def hash_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts]))


def draw(seed: int, index: Column, side: Column | str, size: Column | int) -> Column:
    """A number in ``[0, size)`` that depends on the seed, the index and the side only."""
    side = side if isinstance(side, Column) else F.lit(side)
    size = size if isinstance(size, Column) else F.lit(size)
    digits = F.substring(hash_key(seed, index, side), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), size.cast("bigint"))


def small_side(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of a known row count when it is small; otherwise let Spark choose."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def hash_ranked(
    rows: DataFrame, seed: int, key: str, n: int | None = None, positions: DataFrame | None = None
) -> DataFrame:
    """Add ``sample_rank``, the position in seeded order, and keep the first ``n`` rows.

    With ``positions`` (``sample_rank``, some of them) at least the rows at these are kept.

    Counting the rows per hash prefix (65,536 counters) tells where each prefix starts.
    Prefixes past ``n``, or without a wanted position, are dropped before the shuffle, and each
    remaining prefix is ranked on its own; unique keys spread evenly over prefixes.
    """
    hashed = rows.withColumn("_hash", hash_key(seed, F.col(key)))
    hashed = hashed.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    starts = counts.select(
        "_bucket", (F.sum("_rows").over(Window.orderBy("_bucket")) - F.col("_rows")).alias("_start")
    )
    if n is not None:
        starts = starts.filter(F.col("_start") < n)
    if positions is not None:
        # Prefixes and positions in one order: a position belongs to the last prefix that starts by then.
        marks = starts.select(F.col("_start").alias("_at"), "_bucket").unionByName(
            positions.select(F.col("sample_rank").alias("_at"), F.lit(None).cast("int").alias("_bucket"))
        )
        in_order = Window.orderBy("_at", F.col("_bucket").isNull(), "_bucket")
        held = marks.select("_bucket", F.last("_bucket", ignorenulls=True).over(in_order).alias("_held"))
        wanted = held.filter("_bucket IS NULL").select(F.col("_held").alias("_bucket")).distinct()
        starts = starts.join(wanted, "_bucket", "left_semi")
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    ranked = hashed.join(F.broadcast(starts), "_bucket").withColumn(
        "sample_rank", (F.col("_start") + position - 1).cast("bigint")
    )
    if n is not None:
        ranked = ranked.filter(F.col("sample_rank") < n)
    return ranked.drop("_hash", "_bucket", "_start")


def first_rows(rows: DataFrame, n: int, value: Column, key: str) -> DataFrame:
    """The first ``n`` rows by ``value`` descending (null counts as 0) and then ``key``; all when there are fewer.

    Rows are counted per value, which tells the value at which ``n`` is reached. Among the rows
    of that value the last key still wanted is found the same way, by counting up to keys of a
    sample; only the keys below the first sampled key that is far enough are put in order. What is
    left is a filter on the scan, the same for every ``n``: no full row is shuffled.
    """
    if n <= 0:
        return rows.limit(0)
    value = F.coalesce(value, F.lit(0))
    narrow = rows.select(F.col(key).alias("_key"), value.alias("_value"))
    values = narrow.groupBy("_value").agg(F.count("*").alias("_rows"))
    # One row per distinct value: a text length, so this window is small.
    before = F.sum("_rows").over(Window.orderBy(F.desc("_value"))) - F.col("_rows")
    last = values.select("_value", "_rows", before.alias("_before")).filter(F.col("_before") < n).orderBy("_value").first()
    if last is None:
        return rows
    wanted = n - last["_before"]
    cut = F.lit(last["_value"])
    if wanted >= last["_rows"]:
        return rows.filter(value >= cut)
    last_key = key_at(narrow.filter(F.col("_value") == cut).select("_key"), wanted - 1, last["_rows"])
    return rows.filter((value > cut) | ((value == cut) & (F.col(key) <= F.lit(last_key))))


def key_at(keys: DataFrame, position: int, total: int):
    """The key at ``position`` of ``total`` unique keys (``_key``, any ordered type) in ascending order."""
    parts = 1 << 30
    share = min(parts, max(1, parts * SAMPLED_KEYS // total))
    sample = sorted(row["_key"] for row in keys.filter(F.pmod(F.xxhash64("_key"), F.lit(parts)) < share).collect())
    places = sorted({int(position / total * len(sample) * slack) + 16 for slack in (1.1, 1.5, 3)})
    bounds = [sample[place] for place in places if place < len(sample)]
    if bounds:
        below = keys.agg(*[F.count_if(F.col("_key") <= F.lit(bound)) for bound in bounds]).first()
        enough = [bound for bound, count in zip(bounds, below) if count > position]
        if enough:
            keys = keys.filter(F.col("_key") <= F.lit(enough[0]))
    return placed(keys, "_key").filter(F.col("ordinal") == position).first()["_key"]


def placed(narrow: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``ordinal``, the position in ``order``, to a table of few columns.

    One range partitioning on the whole order, so equal leading values are cut by what follows;
    the rows of each partition are numbered where they are, and the partitions' counts shift them.
    """
    spark = narrow.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    table = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "ordinals")
    # An id is the partition's number above 33 bits that count its rows.
    part, within = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    starts = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start"))
    numbered = table.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row per partition
    return numbered.withColumn("ordinal", F.col("_start") + within).drop("_part", "_place", "_start")


def row_ordinals(rows: DataFrame, value: Column, key: str) -> DataFrame:
    """Add ``ordinal``: the position in the order of ``value`` (a number; null counts as 0) descending, then ``key``.

    Values and keys are stored. A sample of them bounds the partitions, so a hot value is cut by its keys,
    and they are counted per partition: whole rows are then shuffled once, and numbered where they land. The result lies in order, a range per partition. Any ordered type of key will do.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct((-F.coalesce(value, F.lit(0))).cast("double").alias("size"), F.col(key).alias("key"))
    narrow = stored(rows.select(at.alias("_at")), "order-keys")
    n_sampled = max(SAMPLED_KEYS, 16 * n_parts)
    sample = sorted(row["_at"] for row in narrow.orderBy(F.xxhash64("_at.key"), "_at").limit(n_sampled).collect())
    cuts = sorted({place * len(sample) // n_parts for place in range(1, n_parts)}) if sample else []
    bounds = F.array(*[F.struct(F.lit(sample[cut]["size"]), F.lit(sample[cut]["key"])) for cut in cuts])
    bounds = bounds.cast(T.ArrayType(narrow.schema["_at"].dataType))
    counts = narrow.groupBy(_bounds_below(bounds, len(cuts), F.col("_at")).alias("_part")).count()
    n_rows = {row["_part"]: row["count"] for row in counts.collect()}  # a row per partition
    starts = F.lit([0, *accumulate(n_rows.get(part, 0) for part in range(len(cuts)))])

    ranged = rows.withColumn("_at", at).withColumn("_part", _bounds_below(bounds, len(cuts), F.col("_at")))
    ranged = ranged.repartitionById(n_parts, F.col("_part")).sortWithinPartitions("_at")
    # An id is the partition's number above 33 bits that count its rows.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.get(starts.cast("array<bigint>"), F.col("_part"))
    return ranged.withColumn("ordinal", start + within).drop("_at", "_part")


def _bounds_below(bounds: Column, n: int, value: Column) -> Column:
    """How many of ``n`` ascending bounds are less than ``value``, by halving."""
    if n == 0:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(n.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def distinct_positions(seed: int, index: Column, k: int, size: Column) -> Column:
    """``k`` distinct numbers in ``[0, size)`` for every ``index``, each set of ``k`` alike likely.

    The draw of step ``last`` is among the numbers up to ``last``; one that is taken already stands for
    ``last`` itself. That takes ``k`` draws, however many numbers there are. ``size`` must be ``k`` at least.
    """
    size = size.cast("bigint")

    def step(taken: Column, last: Column) -> Column:
        at = draw(seed, index, last, last + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, at), last).otherwise(at))

    return F.aggregate(F.sequence(size - k, size - 1), F.array().cast("array<bigint>"), step)


def sample_pairs(spark: SparkSession, n: int, seed: int, n_left: Column | int, n_right: Column | int) -> DataFrame:
    """``n`` pairs of positions, drawn with replacement."""
    return spark.range(n).select(
        F.col("id").alias("pair_id"),
        draw(seed, F.col("id"), "left", n_left).alias("left_pos"),
        draw(seed, F.col("id"), "right", n_right).alias("right_pos"),
    )


def sample_blocks(
    spark: SparkSession, n_blocks: int, block_size: int, seed: int, n_formats: Column | int, n_examples: Column | int
) -> DataFrame:
    """Blocks of one random pair of distinct formats and ``block_size`` random examples, all as positions."""
    n_formats = n_formats if isinstance(n_formats, Column) else F.lit(n_formats)
    block = F.floor(F.col("id") / block_size)
    drawn = spark.range(n_blocks * block_size).select(
        F.col("id").alias("pair_id"),
        draw(seed, block, "first", n_formats).alias("first_pos"),
        draw(seed, block, "step", n_formats - 1).alias("step"),
        draw(seed, F.col("id"), "example", n_examples).alias("example_pos"),
    )
    return drawn.select(
        "pair_id",
        "first_pos",
        F.pmod(F.col("first_pos") + 1 + F.col("step"), n_formats.cast("bigint")).alias("second_pos"),
        "example_pos",
    )

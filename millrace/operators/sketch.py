"""Bloom filter, Flajolet-Martin counting, reservoir sample and top frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import double_mod, trailing_zeros, utf8_mod

#: Bloom filter: bits, prime and the coefficients of its two functions (fixed values).
BLOOM_BITS = 500000
PRIME = 2454587
BLOOM_A = (147757, 656162)
BLOOM_B = (67579, 976551)

#: Flajolet-Martin: coefficients and moduli of its 35 functions (fixed values).
FM_A = (578, 2564, 264, 3815, 1559, 2565, 1477, 8750, 915, 727, 4086, 6271, 5852, 8762, 8054, 793, 8100, 2819, 7831, 5827, 9433, 285, 3317, 1678, 5006, 6778, 5465, 8757, 7182, 1856, 3995, 5129, 4106, 1337, 5449)
FM_B = (1513, 1429, 8826, 347, 1070, 9638, 7566, 7379, 5802, 9347, 9654, 7002, 5079, 3913, 8834, 7314, 9433, 3072, 2518, 9698, 7453, 5610, 296, 7281, 7629, 7374, 417, 9453, 4590, 9259, 1249, 4845, 4992, 6224, 277)
FM_P = (2276954, 1047918, 688148, 34220, 2387410, 1600048, 249855, 1470353, 1806470, 1557500, 1854053, 606987, 2045999, 2188392, 1681256, 1364234, 749551, 1883710, 1883725, 2038449, 2197411, 1565199, 2372069, 764976, 449126, 1128008, 1643967, 242369, 2451109, 2003795, 53337, 639986, 1285772, 1977587, 1150655)
FM_GROUP = 5


def bloom_bits(names: DataFrame, col: str = "name") -> DataFrame:
    """Distinct set bits of the non-empty names."""
    x = names.where(F.length(col) > 0).select(utf8_mod(F.col(col), PRIME).alias("x")).distinct()
    return x.select(F.explode(F.array(*[double_mod(F.col("x"), a, b, PRIME, BLOOM_BITS) for a, b in zip(BLOOM_A, BLOOM_B)])).alias("bit")).distinct()


def bloom_probe(names: DataFrame, bits: DataFrame, col: str = "name") -> DataFrame:
    """The rows with ``present``: all of the name's bits are set.  Null and empty names count as present.

    The filter has at most BLOOM_BITS bits whatever it was built from, so it is broadcast.
    """
    out = names
    x = utf8_mod(F.col(col), PRIME)
    for i, (a, b) in enumerate(zip(BLOOM_A, BLOOM_B)):
        known = F.broadcast(bits.select(F.col("bit").alias(f"_bit{i}"), F.lit(True).alias(f"_set{i}")))
        out = out.withColumn(f"_h{i}", double_mod(x, a, b, PRIME, BLOOM_BITS))
        out = out.join(known, F.col(f"_h{i}") == F.col(f"_bit{i}"), "left")
    every = F.lit(True)
    for i in range(len(BLOOM_A)):
        every = every & F.col(f"_set{i}").isNotNull()
    present = F.col(col).isNull() | (F.length(col) == 0) | every
    return out.select(*names.columns, present.alias("present"))


def fm_estimate(df: DataFrame, value: str, *keys: str, form: str = "square") -> DataFrame:
    """Distinct values per key by Flajolet-Martin: (keys, n_distinct, estimate).

    Per function the most trailing zeros r gives r squared (``square``) or 2 to the r
    (``power``); means over groups of five functions, then the middle one.  All maxima
    are taken in one aggregation with partial results.
    """
    rows = df.select(*keys, F.col(value).cast("string").alias("_v")).where("_v is not null and _v <> ''").distinct()
    most = []
    for i, (a, b, p) in enumerate(zip(FM_A, FM_B, FM_P)):
        r = trailing_zeros(double_mod(utf8_mod(F.col("_v"), p), a, b, p, BLOOM_BITS))
        most.append(F.max(r).alias(f"_r{i}"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n_distinct"), *most) if keys else rows.agg(F.count("*").alias("n_distinct"), *most).where("n_distinct > 0")
    each = [F.pow(F.col(f"_r{i}"), F.lit(2.0)) if form == "square" else F.pow(F.lit(2.0), F.col(f"_r{i}")) for i in range(len(FM_A))]
    groups = [sum(each[i : i + FM_GROUP], F.lit(0.0)) / FM_GROUP for i in range(0, len(each), FM_GROUP)]
    middle = len(FM_A) // (2 * FM_GROUP)
    return found.select(*keys, "n_distinct", F.element_at(F.array_sort(F.array(*groups)), middle + 1).alias("estimate"))


def reservoir(df: DataFrame, key: str, k: int, seed: int | None = None) -> DataFrame:
    """A uniform sample of k rows: those with the least 64-bit hash of a key (and a seed), ties by key.

    Every row has the same chance whatever the keys' order, as under reservoir sampling, and
    partitions keep k rows each at most, so it needs neither an order of arrival nor a
    single task over all rows.
    """
    h = F.xxhash64(key) if seed is None else F.xxhash64(F.lit(seed).cast("long"), key)
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def top_frequencies(df: DataFrame, value: str, k: int = 3) -> DataFrame:
    """(value, n) with one of the k highest distinct frequencies; ties all stay."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    levels = counts.select("n").distinct().orderBy(F.desc("n")).limit(k)
    return counts.join(F.broadcast(levels), "n", "left_semi").select(value, "n")


def frequency_report(n_seen: int, top: list[tuple[str, int]]) -> str:
    """The text of a report: how many rows came so far, then the most frequent values, highest first and then by value."""
    lines = [f"{value} : {n}" for value, n in sorted(top, key=lambda x: (-x[1], x[0]))]
    return "\n".join([f"The number of tweets with tags from the beginning: {n_seen}", *lines, "", ""])


def dense_top(df: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    """The same within groups, by dense rank."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("n")))).where(F.col("rank") <= k)

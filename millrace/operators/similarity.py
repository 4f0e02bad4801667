"""Jaccard, MinHash-LSH and Pearson similarity between the owners of shared members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import universal
from millrace.operators import pairs
from millrace.session import cut

#: Modulus of the MinHash functions (a fixed value).
MODULUS = 2454587

#: Members up to which an owner's set is held as one array.
ARRAY = 10_000


def coefficients(n: int) -> list[tuple[int, int]]:
    """n fixed pairs (a, b) of hash coefficients, by a rule that SQL can repeat.

    Both are spread over the whole modulus, so that small members, too, are put in orders of all kinds.
    """
    return [(1 + i * i * 104729 % (MODULUS - 1), i * 15485863 % MODULUS) for i in range(1, n + 1)]


def prefixes(rows: DataFrame, need: Column) -> DataFrame:
    """(o, m, n): the members by which owners that share at least ``need`` (of their size n) members must meet.

    An owner's members are put in rising order of how many owners have them; two owners that
    share k members share one of the first n - k + 1 of each.  So members that many owners have
    take part only where an owner has little else.  Owners of more than ``ARRAY`` members
    take part with all of them, so none is ordered in one task.
    """
    owners = rows.groupBy("m").agg(F.count("*").alias("owners"))
    sizes = rows.groupBy("o").agg(F.count("*").alias("n"))
    sized = rows.join(owners, "m").join(sizes, "o")
    rank = F.row_number().over(Window.partitionBy("o").orderBy("owners", "m"))
    small = sized.where(F.col("n") <= ARRAY).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - need + 1)
    return small.select("o", "m", "n").unionByName(sized.where(F.col("n") > ARRAY).select("o", "m", "n"))


def meeting(prefix: DataFrame, fit: Column) -> DataFrame:
    """Distinct (a, b), a < b, of owners that meet in a prefix and whose sizes na and nb fit."""
    left, right = prefix.select(F.col("o").alias("a"), "m", F.col("n").alias("na")), prefix.select(F.col("o").alias("b"), "m", F.col("n").alias("nb"))
    return left.join(right, "m").where((F.col("a") < F.col("b")) & fit).select("a", "b").distinct()


#: Owners up to which a member's owners are paired directly; which way pairs are counted changes no result.
HOT = 2_000


def shared_counts(rows: DataFrame, least: int, share: float = 0.0, fit: Column | None = None) -> DataFrame:
    """(a, b, k), a < b: how many members (o, m) two owners share, of all pairs that share ``least`` and ``share`` of the smaller or more.

    Where no member has more than ``HOT`` owners, which is checked, the pairs of each member are
    counted (``pairs``) and written once.  Beyond, owners must meet in their prefixes, so a member
    that very many owners have makes no square of them, and their sets are then compared.
    """
    found = _lists(rows)
    if found is not None:
        return _as_owners(cut(pairs.shared(found, least, share)), rows)
    return _joined_counts(rows.distinct(), least, share, fit)


def _lists(rows: DataFrame) -> pairs.Lists | None:
    """The lists of owners of rows (o, m), if these are whole numbers and no member is hot."""
    found = pairs.lists(rows) if pairs.countable(rows) else None
    return found if found is not None and found.most <= HOT else None


def _joined_counts(rows: DataFrame, least: int, share: float, fit: Column | None = None) -> DataFrame:
    """``shared_counts`` by joins, of owners and members of any type and of any number of owners a member."""
    most = rows.groupBy("m").agg(F.count("*").alias("owners")).agg(F.max("owners")).first()[0] or 0
    if most <= HOT:
        left, right = rows.select(F.col("o").alias("a"), "m"), rows.select(F.col("o").alias("b"), "m")
        return left.join(right, "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * share - 1e-9)).cast("int")
    return intersections(meeting(prefixes(rows, need), F.lit(True) if fit is None else fit), rows)


def _as_owners(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs with owners of the rows' own type."""
    kind = rows.schema["o"].dataType
    return found.withColumns({"a": F.col("a").cast(kind), "b": F.col("b").cast(kind)})


def jaccard_pairs(members: DataFrame, owner: str, member: str, threshold: float) -> DataFrame:
    """(a, b, sim), a < b, of owners that share a member with Jaccard of at least the threshold."""
    rows = members.select(F.col(owner).alias("o"), F.col(member).alias("m"))
    found = _lists(rows)
    if found is not None:
        return _as_owners(_listed_jaccard(found, 1, threshold), rows)
    # sets link only if the smaller one is at least the threshold's share of the larger, and so is what they share
    rows = rows.distinct()
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    return _jaccard(_joined_counts(rows, 1, threshold, fit), rows.groupBy("o").agg(F.count("*").alias("n")), threshold)


def _listed_jaccard(found: pairs.Lists, least: int, threshold: float) -> DataFrame:
    """Pairs that share ``least`` members with Jaccard of at least the threshold; a pair that does shares that much of either set."""
    both = cut(pairs.shared(found, least, threshold, sizes=True))
    return _jaccard(both.where("a < b"), both.where("a = b").select(F.col("a").alias("o"), F.col("k").alias("n")), threshold)


def _jaccard(both: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    joined = both.join(sizes.select(F.col("o").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("o").alias("b"), F.col("n").alias("nb")), "b")
    sim = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return joined.select("a", "b", sim.alias("sim")).where(F.col("sim") >= threshold)


def minhash(members: DataFrame, owner: str, member: str, bands: int) -> DataFrame:
    """(o, band, sig): the least hash of an owner's members under each function."""
    return signatures(members, owner, member, bands).select("o", F.posexplode("sigs").alias("band", "sig"))


def signatures(members: DataFrame, owner: str, member: str, bands: int) -> DataFrame:
    """(o, sigs): the least hashes of an owner's members, an array a row.

    All minima are taken in one aggregation, so a member row is not multiplied by the bands.  Rows are
    dealt by owner before it: a task then holds minima of its own owners only, not of all that it reads.
    """
    x = F.col("m")
    mins = [F.min(universal(x, a, b, MODULUS)).alias(f"s{i}") for i, (a, b) in enumerate(coefficients(bands))]
    signed = members.select(F.col(owner).alias("o"), F.col(member).alias("m")).repartition("o").groupBy("o").agg(*mins)
    return signed.select("o", F.array(*[f"s{i}" for i in range(bands)]).alias("sigs"))


def lsh_candidates(members: DataFrame, owner: str, member: str, bands: int) -> DataFrame:
    """Distinct (a, b), a < b, of owners that agree in some band of one row."""
    signed = minhash(members, owner, member, bands)
    rows = signed.where("sig is not null").select("o", (F.col("band").cast("long") * MODULUS + F.col("sig")).alias("m"))
    found = _lists(rows)
    if found is not None:
        return _as_owners(pairs.shared(found, 1), rows).select("a", "b")
    left, right = signed.select(F.col("o").alias("a"), "band", "sig"), signed.select(F.col("o").alias("b"), "band", "sig")
    return left.join(right, ["band", "sig"]).where("a < b").select("a", "b").distinct()


def lsh_hits(members: DataFrame, owner: str, member: str, bands: int, threshold: float, least: int = 1) -> DataFrame:
    """(a, b, sim, hit): the pairs that share ``least`` members with Jaccard of at least the (positive) threshold, and whether some band of LSH agrees.

    Owners that agree in a band and share no member have no Jaccard, so where no member is
    hot all shared members are counted, which is fewer than the agreements of many bands, and signatures
    are compared of the few pairs that reach the threshold.  Beyond, LSH finds the candidates.
    """
    rows = members.select(F.col(owner).alias("o"), F.col(member).alias("m"))
    found = _lists(rows)
    if found is not None:
        return _as_owners(_listed_hits(found, bands, threshold, least), rows)
    rows = rows.distinct()
    near = _lsh_joined(rows, bands, threshold, least).select("a", "b", F.lit(True).alias("hit"))
    return jaccard_pairs(rows, "o", "m", threshold).join(near, ["a", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _listed_hits(found: pairs.Lists, bands: int, threshold: float, least: int) -> DataFrame:
    near = cut(_listed_jaccard(found, least, threshold))
    ends = near.select(F.explode(F.array("a", "b")).alias("o")).distinct()
    signed = signatures(pairs.rows_of(found).join(ends, "o", "left_semi"), "o", "m", bands)
    both = near.join(signed.select(F.col("o").alias("a"), F.col("sigs").alias("sa")), "a").join(signed.select(F.col("o").alias("b"), F.col("sigs").alias("sb")), "b")
    return both.select("a", "b", "sim", F.exists(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same).alias("hit"))


def _lsh_joined(rows: DataFrame, bands: int, threshold: float, least: int) -> DataFrame:
    both = intersections(lsh_candidates(rows, "o", "m", bands), rows).where(F.col("k") >= least)
    return _jaccard(both, rows.groupBy("o").agg(F.count("*").alias("n")), threshold)


def lsh_pairs(members: DataFrame, owner: str, member: str, bands: int, threshold: float, least: int = 1) -> DataFrame:
    """LSH candidates with an exact Jaccard of at least the (positive) threshold that share ``least`` members."""
    rows = members.select(F.col(owner).alias("o"), F.col(member).alias("m"))
    found = _lists(rows)
    if found is not None:
        return _as_owners(_listed_hits(found, bands, threshold, least).where("hit").select("a", "b", "sim"), rows)
    return _lsh_joined(rows.distinct(), bands, threshold, least)


def intersections(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, k): how many members (o, m) the two owners of each candidate pair (a, b) share, if any.

    Sets of at most ``ARRAY`` members, which is checked, are compared as arrays, so a
    candidate pair stays one row; larger ones by joining their members.
    """
    if (rows.groupBy("o").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > ARRAY:
        left, right = rows.select(F.col("o").alias("a"), "m"), rows.select(F.col("o").alias("b"), "m")
        return candidates.join(left, "a").join(right, ["b", "m"]).groupBy("a", "b").agg(F.count("*").alias("k"))
    sets = rows.groupBy("o").agg(F.collect_set("m").alias("s"))
    pairs = candidates.join(sets.select(F.col("o").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("o").alias("b"), F.col("s").alias("sb")), "b")
    return pairs.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("k")).where("k > 0")


def pearson_pairs(ratings: DataFrame, owner: str, by: str, least: int = 3, candidates: DataFrame | None = None) -> DataFrame:
    """(a, b, sim), a < b, of owners rated together at least ``least`` times with positive correlation.

    Means are over the common raters.  Pairs that share a rater are counted first, in narrow
    rows; only those with enough common raters are joined again and summed.
    """
    rows = ratings.select(F.col(owner).alias("o"), F.col(by).alias("m"), F.col("stars").alias("r"))
    left = rows.select(F.col("o").alias("a"), "m", F.col("r").alias("x"))
    right = rows.select(F.col("o").alias("b"), "m", F.col("r").alias("y"))
    if candidates is None:
        candidates = shared_counts(rows.select("o", "m"), least).where(F.col("k") >= least)
    both = candidates.select("a", "b").join(left, "a").join(right, ["b", "m"])
    x, y = F.col("x"), F.col("y")
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    sums = sums.where(F.col("n") >= least).select("a", "b", F.expr("xy - sx * sy / n").alias("c"), F.expr("xx - sx * sx / n").alias("vx"), F.expr("yy - sy * sy / n").alias("vy"))
    return sums.where("c > 1e-9 and vx > 1e-9 and vy > 1e-9").select("a", "b", F.expr("c / (sqrt(vx) * sqrt(vy))").alias("sim"))


def user_pearson(ratings: DataFrame, bands: int = 35, jaccard: float = 0.01, least: int = 3) -> DataFrame:
    """Pearson of users that LSH and then Jaccard bring together; those with fewer common items than it needs are left out of both."""
    near = lsh_pairs(ratings, "user", "item", bands, jaccard, least)
    return pearson_pairs(ratings, "user", "item", least, near)

"""k-means (Lloyd) and BFR clustering.  Points stay distributed; centroids and sums are small."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def _assigner(centres: np.ndarray, spreads: np.ndarray | None = None):
    """A function of a feature matrix giving nearest centre and distance; with variances, Mahalanobis."""

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(centres) or not len(x):
            return np.full(len(x), -1), np.full(len(x), np.inf)
        best, at = np.full(len(x), np.inf), np.full(len(x), -1)
        for k, c in enumerate(centres):
            d = (x - c) ** 2
            if spreads is not None:
                on = spreads[k] != 0
                d = d[:, on] / spreads[k][on]
            d = d.sum(1)
            nearer = d < best
            best[nearer], at[nearer] = d[nearer], k
        return at, np.sqrt(best)

    return nearest


def assign(points: DataFrame, centres: np.ndarray, spreads: np.ndarray | None = None) -> DataFrame:
    """(id, features, cluster, distance): the nearest centre of every point, the first at ties."""
    nearest = _assigner(np.asarray(centres, float), spreads)

    def run(frames):
        for frame in frames:
            x = np.stack(frame["features"].to_numpy()) if len(frame) else np.zeros((0, 1))
            at, far = nearest(x.astype(float))
            yield pd.DataFrame({"id": frame["id"], "features": frame["features"], "cluster": at, "distance": far})

    return points.select("id", "features").mapInPandas(run, "id long, features array<double>, cluster int, distance double")


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """(cluster, n, sums, squares) from (cluster, features): partial sums per task, then one row a cluster."""
    def run(frames):
        total: dict = {}
        for frame in frames:
            for k, group in frame.groupby("cluster"):
                x = np.stack(group["features"].to_numpy())
                n, s, q = total.get(k, (0, 0.0, 0.0))
                total[k] = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pd.DataFrame([(k, n, s.tolist(), q.tolist()) for k, (n, s, q) in total.items()], columns=["cluster", "n", "sums", "squares"])

    parts = assigned.select("cluster", "features").mapInPandas(run, "cluster int, n long, sums array<double>, squares array<double>")
    flat = parts.select("cluster", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("pos", "v"))
    summed = flat.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "s", "q")))
    return summed.groupBy("cluster").agg(F.max("n").alias("n"), ordered.alias("v")).select("cluster", "n", F.col("v.s").alias("sums"), F.col("v.q").alias("squares"))


#: First points that are looked at for each starting centre before all are.
FIRST = 20


def first_points(points: DataFrame, k: int) -> np.ndarray:
    """The k points of the least ids with different features, as starting centres."""
    taken = points.select("id", "features").orderBy("id").limit(FIRST * k).collect()
    found = list(dict.fromkeys(tuple(r["features"]) for r in taken))[:k]
    if len(found) < k and len(taken) == FIRST * k:  # so many copies come first that all have to be told apart
        found = [r[0] for r in points.groupBy("features").agg(F.min("id").alias("id")).orderBy("id").limit(k).select("features").collect()]
    return np.array(found, float)


def random_points(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k points with different features, drawn at random: those of the least hash of seed and id."""
    key = F.xxhash64(F.lit(seed).cast("long"), "id")
    rows = points.groupBy("features").agg(F.min(F.struct(key.alias("h"), "id")).alias("at")).orderBy("at").limit(k).select("features").collect()
    return np.array([r[0] for r in rows], float)


#: Sums of many tasks come in any order, so centres that stay the same may differ by rounding, as a share of the largest coordinate.
ROUNDING = 1e-12
#: k-means settles long before so many rounds; if not, it fails.
MOST_ROUNDS = 10_000


#: Bytes of points that are sent to the driver at most, about.
NEAR = 1 << 25
#: Points of a block.
BLOCK = 8192


def _blocks(points: DataFrame) -> DataFrame:
    """(ids, x, width, n): points as matrices of bytes, written once and dealt evenly; numbers that four bytes hold exactly take four."""

    def pack(batches):
        held: list[tuple] = []
        n = 0

        def block():
            ids, x = (np.concatenate(y) for y in zip(*held))
            short = x.astype("<f4")
            width = 4 if np.array_equal(short, x) else 8
            return pa.RecordBatch.from_arrays(
                [pa.array([ids.astype("<i8").tobytes()]), pa.array([(short if width == 4 else x.astype("<f8")).tobytes()]), pa.array([width]), pa.array([len(ids)])],
                names=["ids", "x", "width", "n"],
            )

        for batch in batches:
            if len(batch):
                features = batch.column(1)
                held.append((batch.column(0).to_numpy(zero_copy_only=False), features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)))
                n += len(features)
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    plain = points.select(F.col("id").cast("long"), F.col("features").cast("array<double>"))
    blocks = cut(plain.mapInArrow(pack, "ids binary, x binary, width long, n long"))
    tasks, n = 2 * blocks.sparkSession.sparkContext.defaultParallelism, blocks.count()
    return cut(blocks.repartition(min(n, tasks))) if n > blocks.rdd.getNumPartitions() else blocks


def _matrices(batches):
    """(ids, matrix) of each block."""
    for batch in batches:
        for ids, x, width, n in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(x, f"<f{width}").astype(float).reshape(n, -1)


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every point, the first at ties, and how much further the next one is.

    By one product of matrices, and point by point where that may be too coarse.
    """
    if len(centres) == 1:
        return np.zeros(len(x), int), np.full(len(x), np.inf)
    # points are taken from the middle of the centres, which keeps the products small
    middle = centres.mean(0)
    y, c = x - middle, centres - middle
    squares, own = (c * c).sum(1), (y * y).sum(1)
    far = squares - 2.0 * (y @ c.T)
    at = far.argmin(1)
    two = np.partition(far, 1, 1)[:, :2]
    apart, size = two[:, 1] - two[:, 0], own + squares.max()
    close = ~(apart > 1e-11 * size)
    if close.any():
        at[close] = _assigner(centres)(x[close])[0]
        apart[close] = 0.0
    both = np.sqrt(np.maximum(two + own[:, None], 0)).sum(1)
    return at, np.where(apart > 0, apart / np.maximum(both, 1e-300), 0.0)


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    mine = (np.arange(k)[:, None] == at).astype(float)
    return mine.sum(1), mine @ x


def _pass(blocks: DataFrame, centres: np.ndarray, reach: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """Numbers and sums by cluster of the points whose next centre is more than ``reach`` further, the other points, and how many those are.

    If a task has more than ``most`` of these, they are in the sums, too, and not sent.  Parts are added in the order of the tasks.
    """
    k, dims = centres.shape

    def run(batches):
        number, total = np.zeros(k), np.zeros(centres.shape)
        near: list[np.ndarray] = []
        n, full = 0, False
        for _, x in _matrices(batches):
            at, gap = nearest_centres(x, centres)
            loose = ~(gap > reach)
            n += int(loose.sum())
            if n > most and not full:
                full = True
                for y in near:
                    parts = _sums(y, nearest_centres(y, centres)[0], k)
                    number, total = number + parts[0], total + parts[1]
                near = []
            if not full:
                near.append(x[loose])
                x, at = x[~loose], at[~loose]
            parts = _sums(x, at, k)
            number, total = number + parts[0], total + parts[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), pa.array([number.tobytes()]), pa.array([total.tobytes()]), pa.array([b"".join(y.tobytes() for y in near)]), pa.array([n]), pa.array([full])],
            names=["part", "n", "s", "near", "loose", "full"],
        )

    parts = sorted(blocks.mapInArrow(run, "part long, n binary, s binary, near binary, loose long, full boolean").collect())
    number = sum((np.frombuffer(r["n"]) for r in parts), np.zeros(k))
    total = sum((np.frombuffer(r["s"]).reshape(centres.shape) for r in parts), np.zeros(centres.shape))
    near = np.frombuffer(b"".join(r["near"] for r in parts)).reshape(-1, dims)
    if any(r["full"] for r in parts):
        more = _sums(near, nearest_centres(near, centres)[0], k) if len(near) else (0, 0)
        number, total, near = number + more[0], total + more[1], None
    return number, total, near, sum(r["loose"] for r in parts)


def _placed(blocks: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """(id, cluster, distance) of all points of the blocks."""

    def run(batches):
        for ids, x in _matrices(batches):
            at = nearest_centres(x, centres)[0] if len(centres) else np.full(len(x), -1)
            far = np.sqrt(((x - centres[at]) ** 2).sum(1)) if len(centres) else np.full(len(x), np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(run, "id long, cluster int, distance double").withColumn("id", F.col("id").cast(kind))


def lloyd(points: DataFrame, k: int, rounds: int, centres: np.ndarray | None = None, settle: bool = False, blocks: DataFrame | None = None) -> np.ndarray:
    """Centres after at most ``rounds`` rounds, or when they stay the same; empty clusters keep theirs.

    With ``settle``, centres that still move after ``rounds`` rounds are an error.  Late rounds move centres
    little, and then only points between two centres can change, so a pass over all points
    sends those (``NEAR`` bytes at most, or the pass counts for its own round only) and many rounds follow on the driver.
    The rounds are the same as with a pass each.
    """
    centres = first_points(points, k) if centres is None else np.asarray(centres, float)
    if not len(centres):
        return centres
    blocks = _blocks(points) if blocks is None else blocks
    tasks, n = max(1, blocks.rdd.getNumPartitions()), blocks.agg(F.sum("n")).first()[0] or 0
    held = max(1, NEAR // (8 * centres.shape[1]))
    reach, done = np.inf if n <= held else 0.0, 0
    while done < rounds:
        # points whose next centre is more than ``reach`` further keep theirs until some centre has moved half of that
        number, total, near, loose = _pass(blocks, centres, reach, held if n <= held else 2 * held // tasks)
        start, move = centres, np.inf
        while done < rounds and (start is centres or near is not None and 2 * np.sqrt(((centres - start) ** 2).sum(1)).max() < reach * (1 - 1e-6)):
            more = _sums(near, nearest_centres(near, centres)[0], len(centres)) if near is not None and len(near) else (0, 0)
            count, moved = number + more[0], centres.copy()
            moved[count > 0] = (total + more[1])[count > 0] / count[count > 0, None]
            done += 1
            if np.abs(moved - centres).max() <= ROUNDING * np.abs(centres).max():
                return centres
            move, centres = np.sqrt(((moved - centres) ** 2).sum(1)).max(), moved
        # the next reach lets half as many points be sent as may be, unless centres would leave it in a round or two
        reach = reach * np.clip(held / (2 * loose + 1), 0.05, 20) if reach else 8 * move
        if reach < 4 * move:
            reach = 4 * move if loose < held else reach
    if settle:
        raise RuntimeError(f"centres still move after {rounds} rounds")
    return centres


def kmeans(points: DataFrame, k: int, most_rounds: int = MOST_ROUNDS, seed: int | None = None) -> DataFrame:
    """(id, cluster, distance) when Lloyd's rounds move no centre any more, from the points of the least ids or, with a seed, random ones."""
    points = points.select("id", "features")
    start = None if seed is None else random_points(points, k, seed)
    blocks = _blocks(points)
    return _placed(blocks, lloyd(points, k, most_rounds, start, settle=True, blocks=blocks), points.schema["id"].dataType.simpleString())


class Sets:
    """Clusters by their sums: stable ids, numbers, sums and sums of squares."""

    def __init__(self, dims: int):
        self.ids: list[int] = []
        self.n, self.s, self.q = np.zeros(0), np.zeros((0, dims)), np.zeros((0, dims))

    @property
    def centres(self) -> np.ndarray:
        return self.s / self.n[:, None] if len(self.n) else self.s

    @property
    def variances(self) -> np.ndarray:
        return np.maximum(self.q / self.n[:, None] - self.centres**2, 0) if len(self.n) else self.q

    def add(self, key: int, n: float, s: np.ndarray, q: np.ndarray) -> None:
        if key in self.ids:
            i = self.ids.index(key)
            self.n[i] += n
            self.s[i] += s
            self.q[i] += q
        else:
            self.ids.append(key)
            self.n, self.s, self.q = np.append(self.n, n), np.vstack([self.s, s]), np.vstack([self.q, q])

    def drop(self, key: int) -> tuple[float, np.ndarray, np.ndarray]:
        i = self.ids.index(key)
        out = self.n[i], self.s[i], self.q[i]
        self.ids.pop(i)
        self.n, self.s, self.q = np.delete(self.n, i), np.delete(self.s, i, 0), np.delete(self.q, i, 0)
        return out

    def distance(self, point: np.ndarray, i: int) -> float:
        v = self.variances[i]
        on = v != 0
        return float(np.sqrt(((point[on] - self.centres[i][on]) ** 2 / v[on]).sum()))


def bfr(rounds: Iterable[DataFrame], k: int, dims: int, head: float = 0.1) -> tuple[DataFrame, list[dict]]:
    """(id, cluster) of all points and the counters of every round.

    The first round starts the discard sets by k-means over its first tenth, the
    compression sets by k-means with 3k over the rest.  Points then join the nearest
    discard set, else compression set, within 3 sqrt(dims) Mahalanobis, else the retained
    set, which is clustered again when it holds more than 3k points.  Compression sets
    merge within the same bound; at the end all join their nearest discard set.
    Discard, compression and retained points together are all points seen, each round.
    """
    bound = 3 * dims**0.5
    ds, cs, counters, placed = Sets(dims), Sets(dims), [], []
    retained, moves, fresh = None, {}, k

    def fold(into: Sets, rows: DataFrame) -> None:
        for row in rows.collect():
            into.add(row["cluster"], row["n"], np.array(row["sums"]), np.array(row["squares"]))

    def recluster(points: DataFrame, rounds_: int) -> DataFrame:
        """Clusters points by 3k-means; groups of two or more become compression sets, single points stay."""
        nonlocal fresh
        seen = cut(assign(points, lloyd(points, 3 * k, rounds_)))
        sizes = {r["cluster"]: r["n"] for r in seen.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        names = {c: fresh + i for i, c in enumerate(sorted(c for c, n in sizes.items() if n > 1))}
        fresh += len(names)
        if names:
            table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
            named = cut(seen.where(F.col("cluster").isin(list(names))).withColumn("cluster", table[F.col("cluster")]))
            fold(cs, cluster_stats(named))
            placed.append(named.select("id", "cluster"))
            seen = seen.where(~F.col("cluster").isin(list(names)))
        return cut(seen.select("id", "features"))

    for number, points in enumerate(rounds):
        points = cut(points.select("id", "features"))
        if number == 0:
            n = points.count()
            limit = points.orderBy("id").limit(max(k, int(n * head))).agg(F.max("id")).first()[0]
            first, rest = points.where(F.col("id") <= limit), points.where(F.col("id") > limit)
            start = cut(assign(first, lloyd(first, k, 10)))
            fold(ds, cluster_stats(start))
            placed.append(start.select("id", "cluster"))
            retained = recluster(rest, 5)
        else:
            seen = cut(assign(points, ds.centres, ds.variances))
            near = seen.where(F.col("distance") <= bound)
            names = F.array(*[F.lit(x) for x in ds.ids])
            near = cut(near.withColumn("cluster", F.element_at(names, F.col("cluster") + 1)))
            rest = seen.where(F.col("distance") > bound).select("id", "features")
            fold(ds, cluster_stats(near))
            placed.append(near.select("id", "cluster"))
            if cs.ids:
                seen = cut(assign(rest, cs.centres, cs.variances))
                names = F.array(*[F.lit(x) for x in cs.ids])
                near = cut(seen.where(F.col("distance") <= bound).withColumn("cluster", F.element_at(names, F.col("cluster") + 1)))
                rest = seen.where(F.col("distance") > bound).select("id", "features")
                fold(cs, cluster_stats(near))
                placed.append(near.select("id", "cluster"))
            retained = cut(retained.unionByName(rest))
            if retained.count() > 3 * k:
                retained = recluster(retained, 3)
            merged = True
            while merged:
                merged = False
                for key in list(cs.ids):
                    i = cs.ids.index(key)
                    far = [(cs.distance(cs.centres[i], j), cs.ids[j]) for j in range(len(cs.ids)) if j != i]
                    if far and min(far)[0] <= bound:
                        other = min(far)[1]
                        cs.add(other, *cs.drop(key))
                        moves[key] = other
                        merged = True
                        break
        counters.append({"round": number + 1, "ds_clusters": len(ds.ids), "ds_points": int(ds.n.sum()), "cs_clusters": len(cs.ids), "cs_points": int(cs.n.sum()), "rs_points": retained.count()})

    for key in list(cs.ids):
        at = cs.centres[cs.ids.index(key)]
        moves[key] = min((ds.distance(at, i), ds.ids[i]) for i in range(len(ds.ids)))[1]
    last = assign(retained, ds.centres, ds.variances)
    placed.append(last.select("id", F.element_at(F.array(*[F.lit(x) for x in ds.ids]), F.col("cluster") + 1).alias("cluster")))
    every = placed[0]
    for part in placed[1:]:
        every = every.unionByName(part)
    final = {}
    for key in moves:
        to = key
        while to in moves:
            to = moves[to]
        final[key] = to
    if final:
        table = F.create_map(*[F.lit(x) for pair in final.items() for x in pair])
        every = every.withColumn("cluster", F.coalesce(table[F.col("cluster")], F.col("cluster")))
    return every, counters

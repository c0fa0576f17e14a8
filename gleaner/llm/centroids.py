"""Centroid clustering of whole-number vectors by Orchard search.

Each centroid has a list of all centroids, nearest first. A vector starts at a centroid that is likely to be near (by its place
along one direction), walks that centroid's list, and whenever it finds a closer centroid goes on with the list of that one;
centroids that it has met are marked and not measured again. It stops strictly beyond twice its distance: by the triangle
inequality no centroid from there on is as near, so the result, ties to the smaller number included, is that of measuring
every centroid.

Each round is one pass over the table: tasks keep one sum a centroid, Spark adds them by centroid and component, and only
centroids x components rows reach the driver. Nothing but the centroids (count x width numbers, both parameters) goes to the
tasks, and nothing is written, so a lost executor costs its own part of a round.

Kept are vectors of exactly `width` components, none null or non-finite; other rows, null vectors included, are left out. A null
id counts as the empty text in the choice of the first centroids and stays null. Repeated ids are vectors of their own; among
equal hashes the smaller vector comes first. With fewer vectors than centroids each starts one; an empty table gives no rows.
Components beyond 2^27 after scaling raise an error, as distances would leave a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_schema
from gleaner.llm.vectors import floor_means, is_finite, joined, squared, whole


class Orchard:
    """Finds the nearest of some centroids for many vectors at once, each in its own step of its own walk."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.stack([squared(centroids, c) for c in centroids])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        far = np.unravel_index(np.argmax(apart), apart.shape)
        self.direction = (centroids[far[0]] - centroids[far[1]]).astype(np.float64)
        along = centroids @ self.direction
        self.by_place = np.argsort(along, kind="stable")
        self.cuts = (along[self.by_place][1:] + along[self.by_place][:-1]) / 2
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (ties: the smaller number) and the squared distance to it."""
        n, k = len(x), len(self.centroids)
        at = self.by_place[np.searchsorted(self.cuts, x @ self.direction)]
        best = squared(x, self.centroids[at])
        self.measured += n
        marked = np.zeros((n, k), bool)
        marked[np.arange(n), at] = True
        place, on = np.zeros(n, np.int64), np.arange(n)
        while len(on):
            on = on[place[on] < k]
            on = on[self.apart[at[on], place[on]] <= 4 * best[on]]  # strictly beyond twice the distance nothing can win or tie
            other = self.order[at[on], place[on]]
            place[on] += 1
            new = ~marked[on, other]
            who, other = on[new], other[new]
            marked[who, other] = True
            d = squared(x[who], self.centroids[other])
            self.measured += len(who)
            wins = (d < best[who]) | (d == best[who]) & (other < at[who])
            who = who[wins]
            at[who], best[who], place[who] = other[wins], d[wins], 0
        return at, best


def kept(df: DataFrame, width: int) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") == width) & is_finite("embedding"))


def first_centroids(vectors: DataFrame, count: int, scale: int, seed: int) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("hash"), F.col("embedding").cast("array<double>").alias("v")).orderBy("hash", "v").limit(count).collect()
    return whole(pa.array([r.v for r in rows], pa.list_(pa.float64())), scale, len(rows[0].v)) if rows else np.zeros((0, 0), np.int64)


def sums_of(vectors: DataFrame, centroids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component sums, counts and summed squared distances of each centroid's vectors."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = Orchard(centroids), np.zeros((k, width + 2), np.int64)
        for b in batches:
            x = whole(b.column("embedding"), scale, width)
            at, best = search.nearest(x)
            by = np.argsort(at, kind="stable")
            own, first = np.unique(at[by], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(np.column_stack([x, np.ones_like(best), best])[by], first, axis=0)
        own = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, sums array<long>")
    out = np.zeros((k, width + 2), np.int64)
    for r in parts.select("cluster", F.posexplode("sums").alias("place", "v")).groupBy("cluster", "place").agg(F.sum("v").alias("v")).collect():
        out[r.cluster, r.place] = r.v
    return out[:, :width], out[:, width], out[:, width + 1]


def cluster(df: DataFrame, count: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector, and the final centroids."""
    vectors = kept(df, width)
    centroids = first_centroids(vectors, count, scale, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        sums, counts, _ = sums_of(vectors, centroids, scale)
        centroids = floor_means(centroids, sums, counts)
    spread = sums_of(vectors, centroids, scale)[2]
    arrow, names = arrow_schema(schema), np.array([hashlib.sha256(joined(c).encode()).hexdigest() for c in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for b in batches:
            at, best = search.nearest(whole(b.column("embedding"), scale, width))
            columns = [b.column("vec_id"), at, best, spread[at], np.full(len(at), spread.sum()), names[at]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return vectors.mapInArrow(run, schema), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql(count: int = 8, rounds: int = 10, width: int = 64) -> str:
    kept = f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
WHERE len(embedding) = {width} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {width})"""
    first = f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h, x LIMIT {count}))"
    steps = [kept, first]
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x, c)])"
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (SELECT r, k, CAST({distance} AS BIGINT) AS d FROM v, c{n}) GROUP BY r)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT k, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM v JOIN a{n} USING (r)) GROUP BY k, i)")
            steps.append(f"m{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY k)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.k = m.k"""


OP11_SQL = _sql()

"""Vector codes: product codebooks learned in exact rounds, with norm-of-sum bounds before rescans.

A vector is cut into equal parts, and each part position has its codebook. Every part keeps its entry, the exact distance to it
and the exact distance to the nearest other entry, each with the round in which it was measured. All earlier codebooks are
kept, so that a later round takes the net displacement of an entry since that round, ||c(now) - c(then)||, and not the sum of
what it moved in each round between: by the triangle inequality a part is at most (distance then + net displacement of its
entry) from its entry, and at least (distance then - largest net displacement of the others) from any other. Where the first is
strictly less the entry stays unseen; else the own distance is measured, and only where that does not decide either, all
entries are. So the codes are exactly those of measuring everything, ties to the lower index included.

A round is one pass: tasks read vectors and bounds from the shared folder, write them with new bounds, and add rows with what
their parts add to and take from each entry; Spark sums these by entry. The driver holds parts x entries x width numbers a
round. A lost executor costs its tasks of the round alone; the table of the round before is deleted when the next is there.

Rows whose vector is null or holds null or non-finite components are left out, and so are vectors without components or with a
number of them that the parts don't divide, and those that have not the most frequent length (of equally frequent ones the
longest). Null ids come last in the choice of the first entries; repeated ids are vectors of their own, the smaller vector
first. With fewer vectors than entries each starts one; an empty table gives no rows. Components beyond 2^27 after scaling
raise an error, as distances would leave a long. Null labels are one label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_schema, delete, written
from gleaner.llm.vectors import floor_means, is_finite, joined, nearest_two, squared, whole

#: Bounds are computed in floating point; they must win by more than its errors.
SLACK = 1e-12
#: A label's total meets its rows in so many groups.
SALTS = 16
STATE = "vec_id long, label int, vector array<long>, entry array<int>, near array<long>, near_round array<int>, next array<long>, next_round array<int>"
CHANGE = "part int, changed int, n long, sums array<long>"


class Bounds:
    """The state of the parts of one batch at one position: entry, distances, and when they were measured."""

    def __init__(self, entry, near, near_round, far, far_round):
        self.entry, self.near, self.near_round, self.far, self.far_round = entry, near, near_round, far, far_round

    @classmethod
    def unseen(cls, n: int) -> Bounds:
        return cls(*(np.full(n, -1) for _ in range(5)))

    def scan(self, x: np.ndarray, codebook: np.ndarray, who: np.ndarray, now: int) -> None:
        self.entry[who], self.near[who], self.far[who] = nearest_two(x[who], codebook)
        self.near_round[who] = self.far_round[who] = now

    def advance(self, x: np.ndarray, history: np.ndarray) -> tuple[int, int]:
        """Brings the parts x to the last codebook of history (rounds x entries x width); returns how many distances to own entries and how many whole scans it took."""
        now, codebook = len(history) - 1, history[-1]
        if now == 0:
            self.scan(x, codebook, np.arange(len(x)), 0)
            return 0, len(x)
        if len(codebook) == 1:  # one entry has no other that could win; only its distance is to be known
            self.near, self.near_round = squared(x, codebook[0]), np.full(len(x), now)
            return len(x), 0
        net = np.sqrt(((history - codebook).astype(np.float64) ** 2).sum(axis=2))  # rounds x entries
        # the largest net displacement of an entry but one's own: the largest, or where that is one's own the second
        order = np.argsort(net, axis=1)
        rows = np.arange(len(net))
        first, most, second = order[:, -1], net[rows, order[:, -1]], net[rows, order[:, -2]]
        others = np.where(first[self.far_round] == self.entry, second[self.far_round], most[self.far_round])
        was, moved = np.sqrt(self.far.astype(np.float64)), others
        low = was - moved - SLACK * (was + moved)
        high = (np.sqrt(self.near.astype(np.float64)) + net[self.near_round, self.entry]) * (1 + SLACK)
        unsure = np.flatnonzero(high >= low)
        self.near[unsure] = squared(x[unsure], codebook[self.entry[unsure]])
        self.near_round[unsure] = now
        still = unsure[np.sqrt(self.near[unsure].astype(np.float64)) * (1 + SLACK) >= low[unsure]]
        if len(still):
            self.scan(x, codebook, still, now)
        return len(unsure), len(still)


def parts_of(b: pa.RecordBatch, parts: int, width: int) -> tuple[np.ndarray, list[Bounds]]:
    """The vectors of a batch as rows x parts x width, and the bounds of each part position."""
    flat = lambda name, dtype: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(dtype)
    x = flat("vector", np.int64).reshape(b.num_rows, parts, width)
    columns = [flat(c, np.int64).reshape(b.num_rows, parts) for c in ("entry", "near", "near_round", "next", "next_round")]
    return x, [Bounds(*(c[:, p].copy() for c in columns)) for p in range(parts)]


def lists(values: np.ndarray, like: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), like.value_type)).cast(like)


def usual_length(df: DataFrame, parts: int) -> int:
    n = F.size("embedding")
    rows = df.where(is_finite("embedding") & (n > 0) & (n % parts == 0)).groupBy(n.alias("length")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("length")).limit(1).collect()
    return rows[0].length if rows else 0


def start(vectors: DataFrame, length: int, parts: int, scale: int) -> DataFrame:
    """The table of the first round: whole-number vectors whose parts have no entry yet."""
    arrow = arrow_schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = np.full((b.num_rows, parts), -1)
            x = whole(b.column("embedding"), scale, length)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists(x, arrow.field("vector").type), *(lists(none, f.type) for f in list(arrow)[3:])], schema=arrow)

    return vectors.mapInArrow(run, STATE)


def step(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state at the last codebook of history, and rows of what entries gain and lose (part is null in the others)."""
    _, parts, entries, width = history.shape
    schema = f"{STATE}, {CHANGE}"
    arrow = arrow_schema(schema)
    held = len(list(arrow)) - 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            x, bounds = parts_of(b, parts, width)
            for p, own in enumerate(bounds):
                was = own.entry.copy()
                own.advance(x[:, p], history[:, p])
                moved = np.flatnonzero(was != own.entry)
                rows = np.column_stack([x[moved, p], np.ones(len(moved), np.int64)])
                np.add.at(change[p], own.entry[moved], rows)
                left = was[moved] >= 0
                np.subtract.at(change[p], was[moved][left], rows[left])
            columns = [np.column_stack([getattr(o, c) for o in bounds]) for c in ("entry", "near", "near_round", "far", "far_round")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vector"), *(lists(c, f.type) for c, f in zip(columns, list(arrow)[3:], strict=False)), *(pa.nulls(b.num_rows, f.type) for f in list(arrow)[held:])], schema=arrow)
        p, e = np.nonzero(change.any(axis=2))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(p), f.type) for f in list(arrow)[:held]), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(change[p, e, width]), lists(change[p, e, :width], arrow.field("sums").type)], schema=arrow)

    return state.mapInArrow(run, schema)


def changes(table: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Summed changes as parts x entries x (width + 1), the last of them the count."""
    out = np.zeros((*shape[:2], shape[2] + 1), np.int64)
    rows = table.where("part is not null").select("part", "changed", F.posexplode(F.concat("sums", F.array("n"))).alias("place", "v"))
    for r in rows.groupBy("part", "changed", "place").agg(F.sum("v").alias("v")).collect():
        out[r.part, r.changed, r.place] = r.v
    return out


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vec_id, code (two hexadecimal digits a part), error, label_error and codebooks_sha256 of every kept vector, and the final codebooks (parts x entries x width)."""
    spark = df.sparkSession
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    length = usual_length(df, parts)
    if not length:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"), np.zeros((parts, 0, 0), np.int64)
    vectors, width = df.where(is_finite("embedding") & (F.size("embedding") == length)), length // parts
    first = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    book = whole(pa.array([r.v for r in first], pa.list_(pa.float64())), scale, length).reshape(len(first), parts, width).transpose(1, 0, 2)
    history, total = [book], np.zeros((parts, len(first), width + 1), np.int64)
    state, path = start(vectors, length, parts, scale), None
    for _ in range(rounds):
        table, new = written(step(state, np.stack(history)), "codes")
        total += changes(table, book.shape)
        book = floor_means(book, total[..., :width], total[..., width])
        history.append(book)
        if path:
            delete(spark, path)
        state, path = table.where("part is null").select(*(c.split()[0] for c in STATE.split(", "))), new
    digest = hashlib.sha256(joined(book).encode()).hexdigest()
    books = np.stack(history)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, bounds = parts_of(b, parts, width)
            error = np.zeros(b.num_rows, np.int64)
            for p, own in enumerate(bounds):
                own.advance(x[:, p], books[:, p])
                error += squared(x[:, p], books[-1, p][own.entry])
            codes = [c.tobytes().hex() for c in np.column_stack([o.entry for o in bounds]).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    done, _ = written(state.mapInArrow(finish, "vec_id long, label int, code string, error long"), "coded")
    if path:
        delete(spark, path)
    key = [F.coalesce("label", F.lit(0)).alias("key"), F.col("label").isNull().alias("none")]
    totals = done.groupBy(*key).agg(F.sum("error").alias("label_error")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = done.select("*", *key, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int").alias("salt"))
    return dealt.join(totals, ["key", "none", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), book


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding))""",
        f"q AS MATERIALIZED (SELECT r, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS t(p))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS k FROM v ORDER BY vec_id, x LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT p, k, x AS c FROM f JOIN q USING (r))",
    ]
    distance = "list_sum([(e[1] - e[2]) * (e[1] - e[2]) for e in list_zip(x, c)])"
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, k := k)) AS m FROM (SELECT r, p, k, CAST({distance} AS BIGINT) AS d FROM q JOIN c{n} USING (p)) GROUP BY r, p)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT p, k, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m.k AS k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM q JOIN a{n} USING (r, p)) GROUP BY p, k, i)")
            steps.append(f"m{n} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY p, k)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (p, k))")
    return f"""WITH {", ".join(steps)},
e AS (SELECT r, string_agg(printf('%02x', CAST(m.k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM v JOIN e USING (r)"""


OP12_SQL = _sql()

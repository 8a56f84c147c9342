"""Approximate nearest neighbours: inverted lists with an adaptive scan of dimensions.

Vectors are put in lists by their nearest centroid. A query scans its nearest lists first; the k-th distance
found there bounds its search in the others. Of these it probes those that should hold all but a share
`miss` of the vectors within that bound, by a normal model of the angles in a list: few lists where vectors
form clusters, many where they don't.

Within a list, vectors are rotated by a random orthogonal matrix, so that the squared distance over the first
d of D dimensions estimates the whole; a candidate is given up as soon as that estimate is above the query's
present k-th distance by more than the test's margin. The present k-th distance falls as candidates pass, and
goes along from list to list. Only pairs that pass every column block are measured, in double precision, on
the original vectors.

Centroids are fitted on a bounded sample (documented at centroids_of); every valid vector is indexed. Equal
vectors are one entry that keeps their k + 1 smallest ids, which is all that any answer can need. Small lists
are packed into cells of about `block` entries, large ones split into blocks, and queries into chunks, so
that no task grows with the largest list, and a query moves once to each cell that holds its lists.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length
than most (ties: the shorter), and rows without an id take no part; of rows with an equal id that are
queries the least vector asks, and none of them is an answer to it; ties of distance go to the smaller id;
with fewer than k candidates near, a query probes all lists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, ship

#: Width of a column block, and the margin of the test in standard deviations.
COLUMNS, MARGIN = 16, 2.1
#: Vectors in the sample for centroids, and how many numbers the centroids may have (64 MB).
SAMPLE, NUMBERS = 20_000, 1 << 23


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their number of dimensions."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(finite)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = sizes[0][0] if sizes else 0
    return rows.where(F.size("v") == dims), dims


def centroids_of(rows: DataFrame, n: int, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means on a sample of about SAMPLE vectors, or 8 for each list, drawn by a hash of the id. One job
    writes the sample; one row at least is drawn."""
    want = max(SAMPLE, 8 * lists)
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(31)), 11) / float(1 << 53)
    drawn = materialize(rows.where(draw < want / max(1, n)).select("v"), "ann-sample").toArrow()
    if not len(drawn):
        drawn = rows.orderBy("id", "v").select("v").limit(lists).toArrow()
    return k_means(np.unique(np.stack(drawn.column("v").to_numpy()), axis=0), lists, rounds)


def k_means(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    centre = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = nearest(sample, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centre))
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
    return centre


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[a : a + 4096], centre).argmin(1) for a in range(0, len(x), 4096)])


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, entries: np.ndarray, best: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, entry, squared distance) that no test gave up; queries and entries in rotated coordinates.

    best: each query's least squared distances so far, which the scan updates; bounds: squared distances that
    bound the search from outside. The first entries are few, as there may be no bound yet."""
    dims, out, at, width = entries.shape[1], [], 0, 64
    while at < len(entries):
        e = entries[at : at + width]
        for first in range(0, len(queries), 256):
            own = slice(first, first + 256)
            q, tau = queries[own], np.minimum(best[own, -1], bounds[own]) * (1 + 1e-9)
            d = min(COLUMNS, dims)
            partial = squared(q[:, :d], e[:, :d])
            i, j = np.nonzero(partial <= (tau * bound(d, dims) if d < dims else tau * (1 + 1e-6))[:, None])
            part = partial[i, j]
            while d < dims:
                more = min(COLUMNS, dims - d)
                diff = q[i, d : d + more] - e[j, d : d + more]
                part = part + (diff * diff).sum(1)
                d += more
                keep = part <= tau[i] * (bound(d, dims) if d < dims else 1 + 1e-6)
                i, j, part = i[keep], j[keep], part[keep]
            if len(i):
                out.append((i + first, j + at, part))
                tighten(best[own], i, part)
        at += width
        width = min(1024, 2 * width)
    if not out:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)
    i, j, part = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = part <= np.minimum(best[i, -1], bounds[i]) * (1 + 1e-6)
    return i[keep], j[keep], part[keep]


def tighten(best: np.ndarray, i: np.ndarray, part: np.ndarray) -> None:
    """Merges new distances of queries i into the sorted rows of best."""
    order = np.lexsort((part, i))
    i, part = i[order], part[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    few = place < best.shape[1]
    new = np.full(best.shape, np.inf)
    new[i[few], place[few]] = part[few]
    best[:] = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, : best.shape[1]]


def bound(d: int, dims: int) -> float:
    """The share of a squared distance that d of dims rotated dimensions may show before the hypothesis
    that the pair is within it is given up."""
    return d / dims * (1 + MARGIN / math.sqrt(d)) ** 2


def expected(far: np.ndarray, size: np.ndarray, spread: np.ndarray, tau: np.ndarray, dims: int) -> np.ndarray:
    """How many entries of each list should lie within each query's tau. far: squared distances from queries
    to centroids; spread: mean squared distance of a list's entries from its centroid. The cosine of the angle
    between the two is taken for normal with variance 1 / dims."""
    z = (far + spread - tau[:, None] ** 2) / np.maximum(2 * np.sqrt(far * spread), 1e-12) * math.sqrt(dims)
    z = np.clip(z, -30, 30)
    return size * 0.5 * (1 - np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))


def near_lists(far: np.ndarray, size: np.ndarray, held: np.ndarray, first: int, want: int) -> np.ndarray:
    """Which lists a query scans first: its nearest ones that have entries, `first` at least, until they hold
    `want` ids."""
    order = np.where(size > 0, far, np.inf).argsort(1, kind="stable")
    before = np.cumsum(held[order], axis=1) - held[order]
    out = np.zeros(far.shape, dtype=bool)
    np.put_along_axis(out, order, ((np.arange(far.shape[1]) < first) | (before < want)) & (size[order] > 0), axis=1)
    return out


def late_lists(far, size, spread, tau, dims: int, miss: float) -> np.ndarray:
    """Which lists, densest in expected hits first, should hold all but `miss` of the entries within tau; all
    lists where there is no tau."""
    hits = expected(far, size, spread, np.where(np.isinf(tau), 0, tau), dims)
    order = (-hits / np.maximum(size, 1)).argsort(1, kind="stable")
    run = np.cumsum(np.take_along_axis(hits, order, axis=1), axis=1)
    out = np.zeros(far.shape, dtype=bool)
    np.put_along_axis(out, order, run - np.take_along_axis(hits, order, axis=1) < (1 - miss) * run[:, -1:], axis=1)
    return (out | np.isinf(tau)[:, None]) & (size > 0)


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids: first per batch, then per salt, then in all."""

    def run(batches):
        for b in batches:
            pdf = pd.DataFrame({"id": b.column("id").to_numpy(zero_copy_only=False), "v": b.column("v").to_numpy(zero_copy_only=False)})
            pdf["key"] = [x.tobytes() for x in pdf["v"]]
            pdf = pdf.sort_values("id").groupby("key", sort=False).head(k + 1)
            got = pdf.groupby("key", sort=False).agg(v=("v", "first"), ids=("id", list))
            salt = int(got["ids"].iloc[0][0]) % 64 if len(got) else 0
            yield pa.RecordBatch.from_arrays([pa.array(got["v"], pa.list_(pa.float64())), pa.array(got["ids"], pa.list_(pa.int64())), pa.array([salt] * len(got), pa.int32())], names=["v", "ids", "salt"])

    # -0.0 and 0.0 are one number.
    rows = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    part = rows.mapInArrow(lean(run), "v array<double>, ids array<long>, salt int")
    for keys in (["v", "salt"], ["v"]):
        part = part.groupBy(*keys).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return part


def search(vectors: DataFrame, is_query, *, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", most_lists: int = 4096, first: int = 4, miss: float = 0.08, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query (a condition on `id`)
    picks. first: lists scanned for the bound; miss: the share of entries within it that may stay unseen."""
    spark = vectors.sparkSession
    ship(spark)
    out = "query_id long, rank int, vec_id long, score double"
    rows, dims = valid(vectors, id_col, vec_col)
    if not dims:
        return spark.createDataFrame([], out)
    n = rows.count()
    centre = centroids_of(rows, n, max(1, min(most_lists, NUMBERS // dims, round(math.sqrt(n)))))
    lists = len(centre)
    shared = spark.sparkContext.broadcast((centre, rotation(dims)))  # at most NUMBERS + dims^2 numbers

    def assign(batches):
        for b in batches:
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, dims))
            own = nearest(x, shared.value[0]) if len(b) else np.zeros(0, dtype="int64")
            gap = ((x - shared.value[0][own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(gap)], names=[*b.schema.names, "list", "gap"])

    entries = materialize(_entries(rows, k).mapInArrow(lean(assign), "v array<double>, ids array<long>, list int, gap double"), "ann-entries")
    size, held, spread = np.zeros(lists, dtype="int64"), np.zeros(lists, dtype="int64"), np.zeros(lists)
    for r in entries.groupBy("list").agg(F.count(F.lit(1)), F.sum(F.size("ids")), F.avg("gap")).collect():  # one row for each list
        size[r[0]], held[r[0]], spread[r[0]] = r[1], r[2], r[3]
    # Lists in a row make cells of about `block` entries; a larger list is a cell of several blocks.
    cell = (np.cumsum(size) - size) // block
    cell = np.cumsum(np.diff(cell, prepend=0) > 0).astype("int32")
    blocks = np.maximum(1, np.bincount(cell, size) // block).astype("int32")
    shape = spark.sparkContext.broadcast((size, held, spread, cell))

    def route(batches, near: bool):
        size, held, spread, cell = shape.value
        for b in batches:
            if not len(b):
                continue
            x, tau = np.stack(b.column("v").to_numpy(zero_copy_only=False)), b.column("tau").to_numpy(zero_copy_only=False)
            ids, who = b.column("id").to_numpy(), np.arange(len(x))
            for part in (who[a : a + 256] for a in range(0, len(who), 256)):
                far = squared(x[part], shared.value[0])
                pick = near_lists(far, size, held, first, 4 * k)
                if not near:
                    pick = late_lists(far, size, spread, tau[part], dims, miss) & ~pick
                q, of = np.nonzero(pick)
                edge = np.flatnonzero(np.append(True, (np.diff(q) != 0) | (np.diff(cell[of]) != 0))) if len(q) else np.zeros(0, dtype="int64")
                asked = pa.ListArray.from_arrays(pa.array(np.append(edge, len(q)), pa.int32()), pa.array(of, pa.int32()))
                own = part[q[edge]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), b.column("v").take(pa.array(own)), pa.array(tau[own]), pa.array(cell[of[edge]]), asked], names=["id", "v", "tau", "cell", "lists"])

    def meet(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, e = np.stack(ask["v"].to_numpy()), np.stack(have["v"].to_numpy())
        rq, re = q @ shared.value[1], e @ shared.value[1]
        best, bounds = np.full((len(q), k + 1), np.inf), ask["tau"].to_numpy() ** 2  # the query itself may be among them
        asker = np.repeat(np.arange(len(q)), [len(x) for x in ask["lists"]])
        wanted, of = np.concatenate(ask["lists"].to_numpy()), have["list"].to_numpy()
        found = []
        for one in np.intersect1d(wanted, of):
            who, what = asker[wanted == one], np.flatnonzero(of == one)
            mine = best[who]
            i, j, part = scan(rq[who], re[what], mine, bounds[who])
            best[who] = mine
            found.append((who[i], what[j], part))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        i, j, part = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = part <= np.minimum(best[i, -1], bounds[i]) * (1 + 1e-6)
        i, j = i[keep], j[keep]
        diff = q[i] - e[j]
        score = np.sqrt((diff * diff).sum(1))
        ids = have["ids"].to_numpy()
        n = np.array([len(x) for x in ids])[j]
        found = pd.DataFrame({"query_id": np.repeat(ask["id"].to_numpy()[i], n), "vec_id": np.concatenate([ids[x] for x in j]) if len(j) else [], "score": np.repeat(score, n)})
        found = found[found["query_id"] != found["vec_id"]].sort_values(["query_id", "score", "vec_id"])
        return found.groupby("query_id").head(k)

    def scanned(asked: DataFrame, near: bool) -> DataFrame:
        """What the queries find in their near or late lists."""
        columns = "id long, v array<double>, tau double, cell int, lists array<int>"
        sent = materialize(asked.mapInArrow(lean(lambda batches: route(batches, near)), columns), "ann-queries")
        wanted = {r[0]: r[1] for r in sent.groupBy("cell").count().collect()}  # one row for each cell
        parts = [(i, int(b), max(1, -(-wanted.get(i, 0) // block))) for i, b in enumerate(blocks)]
        parts = F.broadcast(spark.createDataFrame(parts, "cell int, blocks int, chunks int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cells = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(cell)], "list int, cell int"))
        left = sent.join(parts, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("block", each("blocks")).select("cell", "block", "chunk", "id", "v", "tau", "lists")
        right = entries.join(cells, "list").join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("chunk", each("chunks")).select("cell", "block", "chunk", "list", "ids", "v")
        keys = ["cell", "block", "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    found = materialize(scanned(asked.withColumn("tau", F.lit(float("inf"))), True), "ann-near")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("tau"))
    asked = asked.join(kth, "id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf")))).select("id", "v", "tau")
    found = found.unionByName(scanned(asked, False))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

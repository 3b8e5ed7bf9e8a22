"""Approximate nearest neighbours by balanced posting lists.

Vectors are put on posting lists by their nearest centroid; a vector near a boundary goes to further lists
whose centroids are almost as near. Inner products become distances by one more component that gives all
vectors the same length. Centroids come from a bounded sample, lists that would grow too long are split, and
a list that is long all the same (many equal vectors) is stored in parts. A query walks a neighbour graph of
the centroids in memory from near to far and takes the lists whose centroids are within a ratio of the
nearest one's distance; the ratio is the smallest that finds ``target_recall`` of the sample's own
neighbours. Whole lists are scanned, and scores are computed in double precision on the original vectors. A
group of lists and its queries meet in tasks of bounded size: the queries are dealt, the vectors copied to each.

Defined cases: vectors that are null, empty, zero, of another than the commonest dimension, or hold null or
non-finite components take no part, and neither does a null key; of several rows with one key each is a candidate, of all
but itself, and a query of its own; ties go to the smaller key; a query without ``k`` lists' candidates is searched
over all lists; columns beside key and vector are not read, whatever their names; an empty table, or one with a single
vector, gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bounds: vectors of the sample, posting lists; vectors of a list in the mean, of a stored part, of a group of parts.
SAMPLE, MOST_LISTS, LIST_SIZE, PART_SIZE, GROUP_SIZE = 12_000, 2_048, 256, 4_096, 8_192
#: Queries of a group in one task (in the mean; they are dealt by hash), and rows of a batch of routed queries.
TASK_QUERIES, ROUTED_ROWS = 8_192, 4_096
#: Rows of small tables that are broadcast: about 20 MB.
MOST_BROADCAST = 1_000_000
#: Vectors and queries whose rough scores are held at once, and candidates whose scores are taken at once.
SCAN, CUT = 1_024, 65_536
#: A vector goes to at most so many lists, those within this ratio of the nearest centroid's distance.
REPLICAS, BOUNDARY = 2, 1.02
RATIOS = (1.02, 1.05, 1.08, 1.1, 1.12, 1.14, 1.16, 1.18, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0, 4.0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of dim numbers each as rows, from the Arrow buffers."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in chunks)]).reshape(-1, dim)


def _distances(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * a @ c.T, 0))


class Centroids(NamedTuple):
    points: np.ndarray  # of the lists, with the added component
    graph: np.ndarray  # each one's nearest others
    entries: np.ndarray  # where searches start: centroids far from each other, so that no dense group is cut off
    length: float  # the common length
    ratio: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length**2 - (x * x).sum(1), 0))
        return np.c_[x, rest]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """For each vector its lists, -1 where it has fewer than REPLICAS."""
        d = _distances(self.lift(x), self.points)
        n = min(REPLICAS, d.shape[1])
        at = np.argsort(d, axis=1, kind="stable")[:, :n]
        near = np.take_along_axis(d, at, 1)
        return np.where(near <= near[:, :1] * BOUNDARY + 1e-12, at, -1)

    def search(self, q: np.ndarray, ratio: float | None = None) -> list[int]:
        """The lists to scan for one query: best first through the graph, until all open ones are too far."""
        ratio = self.ratio if ratio is None else ratio
        # a query's added component is 0: the order of distances is then that of inner products
        square = float((q * q).sum())

        def dist(at):
            c = self.points[at]
            return np.sqrt(np.maximum(square + (c * c).sum(-1) - 2 * c[..., :-1] @ q, 0)).tolist()

        seen = set(self.entries.tolist())
        open_ = list(zip(dist(self.entries), self.entries.tolist(), strict=True))
        heapq.heapify(open_)
        best, out = min(open_)[0], []
        while open_:
            d, i = heapq.heappop(open_)
            if d > best * ratio + 1e-12 and len(out) >= 2:
                if d > best * ratio * 1.05 + 1e-12:
                    break
            else:
                out.append((d, i))
            best = min(best, d)
            new = [j for j in self.graph[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for x in zip(dist(np.array(new)), new, strict=True):
                    heapq.heappush(open_, x)
        return [i for d, i in out if d <= best * ratio + 1e-12] or [out[0][1]]


def _spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """n points, each the farthest from those before it."""
    picked, far = [0], _distances(points, points[:1])[:, 0]
    while len(picked) < min(n, len(points)):
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, _distances(points, points[picked[-1:]])[:, 0])
    return np.array(sorted(set(picked)))


def fit_centroids(sample: np.ndarray, n: int, length: float, k: int, target_recall: float, seed: int = 5) -> Centroids:
    """Balanced centroids, their graph and the search ratio from a bounded sample."""
    rng = np.random.default_rng(seed)
    bare = Centroids(np.zeros((0, 0)), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), length, 1.0)
    a = bare.lift(sample)
    want = max(1, min(MOST_LISTS, -(-n // LIST_SIZE), len(a) // 8))
    points = a[np.sort(rng.choice(len(a), want, replace=False))]
    for _ in range(10):
        near = _distances(a, points).argmin(1)
        sums = np.zeros_like(points)
        np.add.at(sums, near, a)
        sizes = np.bincount(near, minlength=len(points))
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
    # balance: lists of more than twice the mean are split in two, as long as their vectors differ
    todo, most = list(range(len(points))), max(4, 2 * len(a) // len(points))
    near = _distances(a, points).argmin(1)
    while todo and len(points) < MOST_LISTS:
        i = todo.pop()
        mine = np.flatnonzero(near == i)
        if len(mine) <= most:
            continue
        axis = a[mine] - a[mine].mean(0)
        lead = axis[np.argmax((axis * axis).sum(1))]
        side = axis @ lead > 0
        if side.all() or not side.any():
            continue
        points = np.r_[points, [a[mine[side]].mean(0)]]
        points[i] = a[mine[~side]].mean(0)
        near[mine[side]] = len(points) - 1
        todo += [i, len(points) - 1]
    d = _distances(points, points)
    graph = np.argsort(d, axis=1, kind="stable")[:, 1 : 1 + min(24, len(points) - 1)]
    got = Centroids(points, graph, _spread_out(points, max(16, 2 * math.isqrt(len(points)))), length, 1.0)
    # the ratio: by the sample's own neighbours
    tests = sample[:200]
    score = tests @ sample.T
    score[np.arange(len(tests)), np.arange(len(tests))] = -np.inf
    true = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
    lists = got.lists_of(sample)
    for ratio in RATIOS:
        found = 0.0
        for q, t in zip(tests, true, strict=True):
            found += np.isin(lists[t], got.search(q, ratio)).any(1).mean()
        if found >= target_recall * len(tests):
            break
    return got._replace(ratio=ratio)


def _beside(rows: DataFrame, few: DataFrame, on: str, n: int) -> DataFrame:
    """Join with a table of n rows of a few numbers, broadcast up to MOST_BROADCAST of them."""
    return rows.join(F.broadcast(few) if n <= MOST_BROADCAST else few, on)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", target_recall: float = 0.96) -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest by inner product. ``queries`` is a condition on rows."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    # rid tells rows apart that share a key; it stays as it is written
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()))
    schema = f"query_id long, rank int, {key} long, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = sizes["d"], sizes["n"]
    rows = rows.where(F.size("v") == dim)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    length = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    h = F.xxhash64("id", F.lit(3))
    part = rows.where(F.shiftrightunsigned(h, 24) < int(min(1.0, 1.2 * SAMPLE / n) * (1 << 40))) if n > SAMPLE else rows
    sample = np.array([r["v"] for r in part.orderBy(h, "id").limit(SAMPLE).select("v").collect()], dtype=np.float64)
    if not len(sample):
        sample = np.array([r["v"] for r in rows.orderBy("id").limit(1).select("v").collect()], dtype=np.float64)
    index = fit_centroids(sample, n, length, k, target_recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for at in range(0, batch.num_rows, 2048):
                lists = index.lists_of(x[at : at + 2048])
                r, c = np.nonzero(lists >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(lists[r, c].astype(np.int32)), batch.column(0).slice(at, 2048).take(pa.array(r)), batch.column(1).slice(at, 2048).take(pa.array(r)), batch.column(2).slice(at, 2048).take(pa.array(r))], ["list", "id", "v", "rid"])

    posted = materialize(rows.select("id", "v", "rid").mapInArrow(assign, "list int, id long, v array<double>, rid long"))
    # a row a list, at most MOST_LISTS: parts of long lists, and neighbouring parts in groups of about GROUP_SIZE
    held = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts, total = {}, {}, 0
    group_of: list[int] = []
    for i in range(len(index.points)):
        first[i], parts[i] = len(group_of), max(1, -(-held.get(i, 0) // PART_SIZE))
        for _ in range(parts[i]):
            group_of.append(total // GROUP_SIZE)
            total += held.get(i, 0) // parts[i]
    spark = vectors.sparkSession
    # a row a list and a row a part: a few numbers for each PART_SIZE vectors
    of_list = spark.createDataFrame([(i, first[i], parts[i]) for i in first], "list int, first int, parts int")
    of_piece = spark.createDataFrame(list(enumerate(group_of)), "piece int, g int")
    placed = _beside(posted, of_list, "list", len(first)).withColumn("piece", F.col("first") + F.pmod(F.xxhash64("id", "rid"), F.col("parts")).cast("int"))
    stored = _beside(placed, of_piece, "piece", len(group_of)).select("g", "list", "id", "v", "rid")

    def search(everything: bool):
        """The lists that each query opens."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    lists = [list(range(len(index.points))) if everything else sorted(index.search(v)) for v in _matrix(part.column(1), dim)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32())), part.column(2)], ["id", "v", "lists", "rid"])

        return run

    def groups_of(lists: np.ndarray) -> dict[int, list[int]]:
        """The groups that hold these lists, with the lists in each."""
        to: dict[int, list[int]] = {}
        for j in lists.tolist():
            for g in sorted(set(group_of[first[j] : first[j] + parts[j]])):
                to.setdefault(g, []).append(j)
        return to

    def each(column: pa.ListArray) -> Iterator[np.ndarray]:
        at, values = column.offsets.to_numpy(), column.values.to_numpy()
        return (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries a group."""
        n = np.zeros(group_of[-1] + 1, dtype=np.int64)
        for batch in batches:
            for lists in each(batch.column(0)):
                n[list(groups_of(lists))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["g", "n"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that a query opens, in batches of about ROUTED_ROWS."""
        for batch in batches:
            rows_: list[int] = []
            gs: list[int] = []
            opened: list[list[int]] = []
            for r, lists in enumerate(each(batch.column(2))):
                for g, js in groups_of(lists).items():
                    rows_.append(r)
                    gs.append(g)
                    opened.append(js)
                if len(rows_) >= ROUTED_ROWS or r == batch.num_rows - 1:
                    at = pa.array(rows_, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(opened, pa.list_(pa.int32())), batch.column(3).take(at)], ["g", "id", "v", "lists", "rid"])
                    rows_, gs, opened = [], [], []

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k of one group's vectors for each of a task's queries: list by list, all its queries at once."""
        none = pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in ("query_id", "query_rid", "found", "found_rid", "score")})
        if not left.num_rows or not right.num_rows:
            return none
        left = left.sort_by([("list", "ascending"), ("id", "ascending"), ("rid", "ascending")])
        lists, ids, rids, x = left.column("list").to_numpy(), left.column("id").to_numpy(), left.column("rid").to_numpy(), _matrix(left.column("v"), dim)
        right = right.combine_chunks()
        asking, asking_rid, v = right.column("id").to_numpy(), right.column("rid").to_numpy(), _matrix(right.column("v"), dim)
        at = [o for o in each(right.column("lists").chunk(0))]
        of_query, of_list = np.repeat(np.arange(len(at)), [len(o) for o in at]), np.concatenate(at)
        order = np.argsort(of_list, kind="stable")
        of_query, of_list = of_query[order], of_list[order]
        # the best rough scores so far; with replicas, so many of them hold k vectors at least
        tops = np.full((len(asking), REPLICAS * k), -np.inf)
        qs, rows_ = [], []
        for j in np.unique(of_list).tolist():
            a, b = np.searchsorted(lists, [j, j + 1])
            mine = of_query[np.searchsorted(of_list, j) : np.searchsorted(of_list, j + 1)]
            for first in range(a, b, SCAN):
                last = min(b, first + SCAN)
                for q0 in range(0, len(mine), SCAN):
                    q = mine[q0 : q0 + SCAN]
                    rough = v[q] @ x[first:last].T
                    rough[rids[first:last] == asking_rid[q][:, None]] = -np.inf
                    both = np.concatenate((tops[q], rough), axis=1)
                    tops[q] = np.partition(both, both.shape[1] - tops.shape[1], axis=1)[:, -tops.shape[1] :]
                    edge = tops[q].min(axis=1)
                    slack = np.where(np.isfinite(edge), 1e-9 * np.maximum(1.0, np.abs(edge)), 0.0)
                    r, c = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
                    qs.append(q[r])
                    rows_.append(c + first)
        q, r = np.concatenate(qs), np.concatenate(rows_)
        near = np.concatenate([(x[r[i : i + CUT]] * v[q[i : i + CUT]]).sum(1) for i in range(0, len(q), CUT)] or [np.zeros(0)])  # equal vectors get equal scores
        order = np.lexsort((rids[r], ids[r], -near, q))
        q, r, near = q[order], r[order], near[order]
        once = np.concatenate(([True], (q[1:] != q[:-1]) | (rids[r[1:]] != rids[r[:-1]])))[: len(q)]  # replicas
        q, r, near = q[once], r[once], near[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, r, near = q[place < k], r[place < k], near[place < k]
        return pa.table({"query_id": pa.array(asking[q]), "query_rid": pa.array(asking_rid[q]), "found": pa.array(ids[r]), "found_rid": pa.array(rids[r]), "score": pa.array(near)})

    best = Window.partitionBy("query_id", "query_rid").orderBy(F.desc("score"), "found", "found_rid")

    def answer(asked: DataFrame, everything: bool) -> DataFrame:
        opened = materialize(asked.select("id", "v", "rid").mapInArrow(search(everything), "id long, v array<double>, lists array<int>, rid long"))
        asking = opened.select("lists").mapInArrow(tally, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
        needed = [(r["g"], -(-r["n"] // TASK_QUERIES)) for r in asking]
        tasks = spark.createDataFrame(needed, "g int, tasks int")
        sent = _beside(opened.mapInArrow(route, "g int, id long, v array<double>, lists array<int>, rid long"), tasks, "g", len(needed))
        sent = sent.withColumn("task", F.pmod(F.xxhash64("id", "rid"), F.col("tasks")).cast("int")).drop("tasks")
        held = _beside(stored, tasks, "g", len(needed)).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        near = held.groupBy("g", "task").cogroup(sent.groupBy("g", "task")).applyInArrow(scan, "query_id long, query_rid long, found long, found_rid long, score double")
        once = near.groupBy("query_id", "query_rid", "found", "found_rid").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_rid", "query_id", "rank", F.col("found").alias(key), "score")

    asked = rows.where("q")
    found = materialize(answer(asked, False))
    enough = found.groupBy("query_rid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_rid").alias("rid"))
    short = materialize(asked.join(enough, "rid", "left_anti"))
    if short.take(1) and n >= 2:
        found = found.join(short.select(F.col("rid").alias("query_rid")), "query_rid", "left_anti").unionByName(answer(short, True))
    return found.drop("query_rid")

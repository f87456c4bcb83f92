"""Approximate nearest neighbours by an inverted multi-index.

The two halves of each unit vector are quantised apart, by k-means fitted on a bounded sample
(``most`` rows), with a centroid for ``ROWS_PER_CENTROID`` rows of the sample, at most
``MAX_CENTROIDS``; a cell is a pair of centroids. A query takes cells by the sum of its two
distances, cheapest first, with a heap, until they hold ``visit`` of all indexed rows, and
every row of those cells is reranked by its exact cosine in double precision. Isotropic
vectors have no clusters to exploit; ``visit`` is a share, so that it behaves alike at every
size, and the default reads 0.4 of the rows for a recall above 0.9 there.

Vectors of the commonest length are indexed; rows of another length are compared with the
queries of that length only, all of them, as a cosine needs vectors of one length.

Scale. Of rows with one vector only the ``k + 1`` smallest ids can be answers, so the others
are left out before the shuffle. The cells of one first-half centroid make up a shelf. A query
is sent to a shelf once, with the cells that it visits there; shelves and queries meet in
groups of at most about ``BLOCK`` rows and ``BLOCK`` queries, to which large shelves and many queries
are dealt by a hash. So rows and queries are sent once per group that they are in: work and shuffle
grow with queries times rows, the shuffle divided by ``BLOCK``. The driver and the tasks hold
the centroids and one row count per cell (``MAX_CENTROIDS`` squared).

Defined results: null, empty or zero vectors, vectors with null or non-finite components and
null ids take no part; an id with several vectors stands for all of them, and the score of two
ids is the best of their pairs; repeated rows count once; ties go to the smaller id; fewer than
``k`` candidates give fewer ranks; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import checkpointed

ROWS_PER_CENTROID, MIN_CENTROIDS, MAX_CENTROIDS = 8, 16, 256
BLOCK = 32_768


def usable(frame: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """(id, v, asks): the distinct rows that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = frame.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.filter(fine).filter(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id", "v").agg(F.bool_or("asks").alias("asks"))


def k_means(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = (2 * rows @ centres.T - (centres**2).sum(1)).argmax(1)
        for j in range(len(centres)):
            own = rows[near == j]
            if len(own):
                centres[j] = own.mean(0)
    return centres


def cheapest_cells(da: np.ndarray, db: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells (i * len(db) + j) by da[i] + db[j], until they hold ``wanted`` rows."""
    a, b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    heap, cells, held = [(da[a[0]] + db[b[0]], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(db) + int(b[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (da[a[i]] + db[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (da[a[i + 1]] + db[b[0]], i + 1, 0))
    return cells


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def nearest(frame: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, visit: float = 0.4, most: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``is_query`` admits."""
    spark = frame.sparkSession
    rows = checkpointed(usable(frame, key, vector, is_query))
    queries = rows.filter("asks").select("id", "v")
    first = Window.partitionBy("v").orderBy("id")
    indexed = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).select("id", "v")
    by_length = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}
    if not by_length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = min(by_length, key=lambda n: (-by_length[n], n))
    common = indexed.filter(F.size("v") == length)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(min(1 << 20, (most << 20) // by_length[length] + 64))
    sample = common.filter(share).orderBy("id").limit(2 * most).select("v").toArrow()["v"]
    if len(sample) == 0:
        sample = common.orderBy("id").limit(1).select("v").toArrow()["v"]
    sample = _unit(_matrix(sample))
    half = (length + 1) // 2
    size = min(max(len(sample) // ROWS_PER_CENTROID, MIN_CENTROIDS), MAX_CENTROIDS)
    halves = (k_means(sample[:, :half], size), k_means(sample[:, half:], size))
    held = spark.sparkContext.broadcast(halves)
    n_a, n_b = len(halves[0]), len(halves[1])

    def distances(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = held.value
        return (a * a).sum(1) - 2 * unit[:, :half] @ a.T, (b * b).sum(1) - 2 * unit[:, half:] @ b.T

    def by_kind(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(vector length, rows of it)."""
        sizes = pc.list_value_length(batch.column(1))
        for n in pc.unique(sizes).to_pylist():
            yield n, batch.filter(pc.equal(sizes, n))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in by_kind(batch):
                shelf, cell = np.full(part.num_rows, -n), np.zeros(part.num_rows, np.int64)
                if n == length:
                    da, db = distances(_unit(_matrix(part.column(1))))
                    shelf, cell = da.argmin(1), db.argmin(1)
                columns = [part.column(0), part.column(1), pa.array(shelf, pa.int32()), pa.array(cell, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "shelf", "cell"])

    placed = checkpointed(indexed.mapInArrow(to_cells, "id long, v array<double>, shelf int, cell int"))
    counts, sizes = np.zeros(n_a * n_b, np.int64), {}
    for r in placed.groupBy("shelf", "cell").count().collect():  # MAX_CENTROIDS squared rows and one per odd length
        sizes[r["shelf"]] = sizes.get(r["shelf"], 0) + r["count"]
        if r["shelf"] >= 0:
            counts[r["shelf"] * n_b + r["cell"]] = r["count"]
    blocks = {shelf: -(-n // BLOCK) for shelf, n in sizes.items()}
    total = int(counts.sum())
    lots = max(1, -(-queries.count() // BLOCK))
    known = spark.sparkContext.broadcast((counts, blocks))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, blocks = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for n, part in by_kind(batch.slice(at, 64)):
                    row, shelf, block, cells = [], [], [], []
                    if n == length:
                        da, db = distances(_unit(_matrix(part.column(1))))
                    for i in range(part.num_rows):
                        marks = {-n: np.ones(n_b, bool)}
                        if n == length:
                            marks = {}
                            for c in cheapest_cells(da[i], db[i], counts, max(visit * total, k + 1)):
                                marks.setdefault(c // n_b, np.zeros(n_b, bool))[c % n_b] = True
                        for s, mark in marks.items():
                            for b in range(blocks.get(s, 0)):
                                row.append(i)
                                shelf.append(s)
                                block.append(b)
                                cells.append(np.packbits(mark).tobytes())
                    took = part.take(pa.array(row, pa.int64()))
                    columns = [*took.columns, pa.array(shelf, pa.int32()), pa.array(block, pa.int32()), pa.array(cells, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "v", "shelf", "block", "cells"])

    probes = queries.mapInArrow(visits, "id long, v array<double>, shelf int, block int, cells binary").withColumn(
        "lot", F.pmod(F.xxhash64("id", "v"), F.lit(lots)).cast("int")
    )
    split = {s: b for s, b in blocks.items() if b > 1}
    n_blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in split.items() for x in pair]), F.col("shelf")), F.lit(1)) if split else F.lit(1)
    shelves = placed.withColumn("block", F.pmod(F.xxhash64("id", "v"), n_blocks).cast("int")).withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))
    )

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("cell", "ascending"), ("id", "ascending")])
            raw, ids, cell = _matrix(right["v"]), right["id"].to_numpy(), right["cell"].to_numpy()
            unit, repeats = _unit(raw), len(np.unique(ids)) < len(ids)
            asked, names = _matrix(left["v"]), left["id"].to_numpy()
            unit_asked = _unit(asked)
            for i, mark in enumerate(left["cells"].to_pylist()):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(mark, np.uint8))[:n_b].astype(bool)[cell])
                near = unit[at] @ unit_asked[i]
                keep = ids[at] != names[i]
                at, near = at[keep], near[keep]
                if not len(at):
                    continue
                if repeats:  # the best of each id
                    order = np.lexsort((-near, ids[at]))
                    order = order[np.append(True, np.diff(ids[at][order]) != 0)]
                    at, near = at[order], near[order]
                kth = np.partition(near, -min(k, len(at)))[-min(k, len(at))]
                at = at[near >= kth - 1e-9]
                a, b = asked[i], raw[at]
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (b * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))  # row by row, so that copies tie
                odd = ~np.isfinite(exact)  # squares beyond the range of doubles
                exact[odd] = unit[at[odd]] @ unit_asked[i]
                out.append(pa.table({"query_id": np.full(len(at), names[i]), "vec_id": ids[at], "score": exact}))
        return pa.concat_tables(out)

    on = ["shelf", "block", "lot"]
    found = probes.groupBy(*on).cogroup(shelves.groupBy(*on)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

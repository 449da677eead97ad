"""Exact top-k by inner product over a bit-sliced index.

Attributes (vector elements) are quantised to ``BITS`` bits and stored by
slices: for each attribute and bit one bitmap over the rows of a block. A query
becomes small integer weights. Its score for all rows of a block is the sum of
the slices that its weights' bits select, formed by carry-save adders on whole
bitmaps; a negative weight takes the complement. The k-th best quantised sum is
found from the most significant slice of the result downward. Rows within twice
the quantisation error of it, again by slices, are the boundary; they alone are
scored exactly. The bound on the error holds for every row, so no row of the
true top k is missed.

A query is first scored exactly against SAMPLE_ROWS rows. The k-th best there is
a bound that all blocks share: no row below it can be among the best, so a
block returns and verifies what may beat it and often nothing.

Every (block of queries, block of rows) is one task; blocks of rows are read
from the shared folder. The local lists are merged by query. With all rows as
queries the work is quadratic by nature; pass fewer ``queries`` to avoid that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import new_path, stored

BITS = 6
WEIGHT_BITS = 4
BLOCK_ROWS = 1 << 16
QUERY_ROWS = 1 << 10
DIGITS = 9
SAMPLE_ROWS = 2048


def sliced(levels: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of levels (rows, attributes): shape (attributes, bits, words)."""
    rows, width = levels.shape
    padded = np.zeros((-(-rows // 64) * 64, width), np.uint16)
    padded[:rows] = levels
    out = np.empty((width, bits, len(padded) // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(np.ascontiguousarray(((padded >> b) & 1).astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64)
    return out


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of a sum; ``columns[i]`` lists stacks of bitmaps of weight 2**i."""
    out, i = [], 0
    while i < len(columns):
        parts = columns[i]
        if not parts:
            out.append(None)
            i += 1
            continue
        x = np.concatenate(parts) if len(parts) > 1 else parts[0]
        while len(x) > 1:
            if i + 1 == len(columns):
                columns.append([])
            if len(x) == 2:
                columns[i + 1].append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
                break
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            half = a ^ b
            columns[i + 1].append((a & b) | (c & half))
            x = np.concatenate([half ^ c, x[3 * n :]])
        out.append(x[0])
        i += 1
    width = next(s for s in out if s is not None).shape
    return [np.zeros(width, np.uint64) if s is None else s for s in out]


def kth_sum(slices: list[np.ndarray], valid: np.ndarray, k: int) -> int:
    """The k-th largest sum, found from the top slice down."""
    sure, tied, value = 0, valid, 0
    for i in range(len(slices) - 1, -1, -1):
        ones = tied & slices[i]
        n = int(np.bitwise_count(ones).sum())
        if sure + n >= k:
            tied, value = ones, value | (1 << i)
        else:
            sure, tied = sure + n, tied & ~slices[i]
    return value


def at_least(slices: list[np.ndarray], valid: np.ndarray, bound: int) -> np.ndarray:
    """The bitmap of valid rows whose sum is ``bound`` or more."""
    if bound <= 0:
        return valid
    if bound >> len(slices):
        return np.zeros_like(valid)
    above, equal = np.zeros_like(valid), valid
    for i in range(len(slices) - 1, -1, -1):
        if bound >> i & 1:
            equal = equal & slices[i]
        else:
            above |= equal & slices[i]
            equal = equal & ~slices[i]
    return above | equal


class Block:
    """One block of rows, for searching."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.ids, self.values, self.slices, self.low, self.step = ids, values, slices, low, step
        self.complement = ~slices
        rows, _ = values.shape
        marks = np.zeros(slices.shape[2] * 64, np.uint8)
        marks[:rows] = 1
        self.valid = np.packbits(marks, bitorder="little").view(np.uint64)
        top = (1 << slices.shape[1]) - 1
        levels = np.clip(np.rint((values - low) / step), 0, top)
        self.middle = top / 2
        self.off = float(np.sqrt((((values - low) / step - levels) ** 2).sum(axis=1).max()))
        self.spread = float(np.sqrt(((levels - self.middle) ** 2).sum(axis=1).max()))

    def search(self, query: np.ndarray, k: int, own: int, weight_bits: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rounded exact scores of the best k rows; ties by id.

        Rows that score under ``least`` may be left out.
        """
        exact = query * self.step
        peak = np.abs(exact).max()
        want = k + 1  # its own row may be among them
        if peak > 0 and len(self.ids) > want:
            factor = ((1 << weight_bits) - 1) / peak
            exact = exact * factor
            weight = np.rint(exact).astype(np.int64)
            columns: list[list[np.ndarray]] = [[] for _ in range(weight_bits + self.slices.shape[1] - 1)]
            for j in range(weight_bits):
                chosen = (np.abs(weight) >> j) & 1 > 0
                for side, at in ((self.slices, np.flatnonzero(chosen & (weight > 0))), (self.complement, np.flatnonzero(chosen & (weight < 0)))):
                    if len(at):
                        for i in range(side.shape[1]):
                            columns[i + j].append(side[at, i])
            slices = add_slices(columns)
            error = np.linalg.norm(exact - weight) * self.spread + np.linalg.norm(exact) * self.off
            bound = kth_sum(slices, self.valid, want) - int(np.ceil(2 * error * (1 + 1e-9) + 1e-6))
            if least > -np.inf:
                top = (1 << self.slices.shape[1]) - 1
                level = factor * (least - query @ self.low) - self.middle * (exact - weight).sum() + top * np.abs(weight[weight < 0]).sum()
                bound = max(bound, int(np.floor(level - error * (1 + 1e-9) - 1e-6 * (1 + abs(level)))))
            marks = at_least(slices, self.valid, bound)
            rows = np.flatnonzero(np.unpackbits(marks.view(np.uint8), bitorder="little"))
        else:
            rows = np.arange(len(self.ids))
        rows = rows[self.ids[rows] != own]
        score = np.round(self.values[rows].astype(np.float64) @ query, DIGITS)
        rows, score = rows[score >= least], score[score >= least]
        by = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][by], score[by]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None) -> tuple[DataFrame, int]:
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v"))
    if dim is None:
        dim = rows.agg(F.min_by(F.size("v"), "id")).first()[0] or 0
    return rows.where(F.size("v") == dim).groupBy("id").agg(F.max("v").alias("v")), dim


def _index(rows: DataFrame, dim: int, block_rows: int, path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Write the index; the number of blocks, and the quantisation."""
    limits = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").toPandas()
    low = limits.lo.to_numpy(np.float64)
    step = np.maximum((limits.hi.to_numpy(np.float64) - low) / ((1 << BITS) - 1), 1e-12)
    count = max(1, -(-rows.count() // block_rows))

    def build(table: pa.Table) -> pa.Table:
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids = table["id"].to_numpy()
        levels = np.clip(np.rint((values - low) / step), 0, (1 << BITS) - 1).astype(np.uint16)
        cells = [ids.astype(np.int64).tobytes(), values.astype(np.float32).tobytes(), sliced(levels, BITS).tobytes()]
        return pa.table({"block": table["block"][:1], **{n: pa.array([c], pa.binary()) for n, c in zip(("ids", "vals", "slices"), cells)}})

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy("block").applyInArrow(build, "block int, ids binary, vals binary, slices binary")
    blocks.write.partitionBy("block").parquet(path)
    return count, low, step


def top_k(vectors: DataFrame, *, k: int = 10, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, score): the k largest inner products.

    Every row is a query unless ``queries`` (same columns) is given. A query's
    own id is never among its results. Scores are rounded to 9 digits; equal
    ones are ordered by id. Fewer than k other rows give fewer results.

    Defined cases: rows without an id, and vectors that are null, empty, hold a
    null or no finite number, or differ in length from ``dim`` (by default that
    of the lowest id) are neither queries nor results. Rows that share an id
    are one row, with the greatest of their vectors in array order. A vector of
    zeros scores 0 with all. Other columns are not looked at. An empty table
    gives none.
    """
    spark = vectors.sparkSession
    rows, dim = _usable(vectors, id_col, vector_col, dim)
    rows = stored(rows, "vectors")
    asked = rows if queries is None else _usable(queries, id_col, vector_col, dim)[0]
    out = "query_id long, neighbor_id long, score double"
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, score double")
    path = new_path(spark, "slices")
    count, low, step = _index(rows, dim, block_rows, path)
    groups = max(1, -(-asked.count() // query_rows))
    some = rows.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).toArrow()
    sample = spark.sparkContext.broadcast((some["id"].to_numpy(), some["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)))

    def bounds(q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The k-th best score of each query in the sample, a little lower."""
        ids, values = sample.value
        score = q @ values.T.astype(np.float64)
        score[ids[None] == own[:, None]] = -np.inf
        if len(ids) < k:
            return np.full(len(q), -np.inf)
        return np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] - 10.0**-DIGITS * (1 + np.abs(q).sum(axis=1))

    def run(batches):
        files, root = fs.FileSystem.from_uri(path)
        held: dict[int, Block] = {}
        for batch in batches:
            asked_ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            q = batch.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            least = bounds(q, np.array(asked_ids))
            found: list[list[np.ndarray]] = [[], [], []]
            for block in np.unique(wanted):
                if block not in held:
                    held.clear()
                    table = pads.dataset(f"{root}/block={block}", filesystem=files, format="parquet").to_table(columns=["ids", "vals", "slices"])
                    if not table.num_rows:
                        continue
                    cells = [table[c][0].as_buffer() for c in ("ids", "vals", "slices")]
                    ids = np.frombuffer(cells[0], np.int64)
                    held[block] = Block(ids, np.frombuffer(cells[1], np.float32).reshape(-1, dim), np.frombuffer(cells[2], np.uint64).reshape(dim, BITS, -1), low, step)
                for at in np.flatnonzero(wanted == block):
                    ids, score = held[block].search(q[at], k, asked_ids[at], WEIGHT_BITS, least[at])
                    for part, x in zip(found, (np.full(len(ids), asked_ids[at]), ids, score)):
                        part.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["query_id", "neighbor_id", "score"])

    present = spark.createDataFrame([(b,) for b in _blocks(rows, count)], "b int")
    tasks = asked.withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))).crossJoin(F.broadcast(present)).repartition(groups * count, "g", "b")
    local = tasks.select("id", "v", "b").mapInArrow(run, out)
    local = stored(local, "local_topk")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbor_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "score")


def _blocks(rows: DataFrame, count: int) -> list[int]:
    return [r[0] for r in rows.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).distinct().collect()]

"""Near-duplicate documents by SimHash, all pairs within the distance.

A document's words, weighted by one plus the logarithm of their counts (so that
no mark or function word can outvote the rest), vote on a
fingerprint of ``SEGMENTS * SEGMENT_BITS`` bits. Weights are whole numbers of
1 / ``WEIGHT_UNIT``, so that votes add up exactly: a text has one fingerprint,
whatever texts it is read with, and a tied vote is none. Two documents are linked if
their fingerprints differ by ``max_distance`` bits at most and so do sketches of
their neighbouring words by ``max_sketch_distance``, which keeps texts apart
that share marks and function words alone.

The search is exact. Fingerprints are cut in parts, and each part is searched up
to a radius of its own. As the radii plus one add up to ``max_distance`` + 1, a
pair that no part finds is further apart than that. A part is searched by the
values of it that occur: every value meets those that differ by a mask of as
many bits as its radius or less, and their rows are verified on sketches and whole
fingerprints. Which parts and radii are cheapest is estimated from a sample of
rows; it changes the work, never the result.

Documents with one fingerprint are one node, so groups of thousands of copies
cost one row. Verified pairs are closed into groups by alternating star
contraction; each group is named by its lowest id.

Pairs of blocks of nodes are tasks. The candidates of a part grow with the
square of the nodes (a few in a hundred of all pairs at 18 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .scratch import checkpointed, fresh, new_path, stored
from .words import chunks, split_words

SEGMENTS = 7
SEGMENT_BITS = 18
MAX_DISTANCE = 22
SKETCH_BITS = 44
CHUNK_BYTES = 1 << 20
SKETCH_DISTANCE = 14
WORDS_AT_ONCE = 1 << 16
PART_WORDS = 1 << 14
WEIGHT_UNIT = 1 << 12
EXACT_FLOAT32 = 1 << 24
BLOCK_ROWS = 1 << 18
LEAST_ROWS = 1 << 14
SPREAD = 5
INDEX_BITS = 18
PAIRS_AT_ONCE = 1 << 18
CANDIDATE_COST = 30  # in lookups of a value
CALL_COST = 2000


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _sketch(hashed: np.ndarray) -> int:
    """Votes of a text's distinct neighbouring words on SKETCH_BITS bits."""
    if len(hashed) > 1:
        hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashed[1:] ^ (hashed[1:] >> np.uint64(29)))
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed = hashed ^ (hashed >> np.uint64(30))
    pairs = np.unique(hashed)
    places = np.arange(SKETCH_BITS, dtype=np.uint64)
    votes = np.zeros(SKETCH_BITS, np.int64)
    for at in range(0, len(pairs), PART_WORDS):
        votes += ((pairs[at : at + PART_WORDS, None] >> places) & np.uint64(1)).sum(axis=0).astype(np.int64)
    return int((votes * 2 > len(pairs)).astype(np.int64) @ (1 << np.arange(SKETCH_BITS)))


def _signs(words: list[str], bits: int) -> np.ndarray:
    raw = b"".join(xxhash.xxh128_digest(w) for w in words)
    signs = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(words), 16), axis=1)[:, :bits].astype(np.float32)
    signs *= 2
    signs -= 1
    return signs


def fingerprints(text: pa.Array, segments: int, segment_bits: int) -> np.ndarray:
    """Segment values and a sketch of every text, shape (rows, segments + 1); blank texts get 0.

    Where texts have more than WORDS_AT_ONCE distinct words, votes are added up
    in parts, so a long text takes little more memory than its words. All sums
    are of whole numbers that their type holds, so their order doesn't count.
    """
    bits = segments * segment_bits
    out = np.zeros((len(text), segments + 1), np.int64)
    scale = (1 << np.arange(segment_bits - 1, -1, -1)).astype(np.int64)
    for start, part in chunks(text, CHUNK_BYTES):
        offsets, codes, words = split_words(part)
        if not len(words):
            continue
        names = words.to_pylist()
        hashed = _hashes(names)
        signs = _signs(names, bits) if len(names) <= WORDS_AT_ONCE else None
        for row in range(len(part)):
            own = codes[offsets[row] : offsets[row + 1]]
            if len(own):
                found, counts = np.unique(own, return_counts=True)
                weights = np.rint(WEIGHT_UNIT * (1 + np.log(counts)))
                if signs is not None and weights.sum() < EXACT_FLOAT32:
                    votes = weights.astype(np.float32) @ signs[found]
                else:
                    votes = np.zeros(bits)
                    for at in range(0, len(found), PART_WORDS):
                        some = found[at : at + PART_WORDS]
                        own_signs = signs[some] if signs is not None else _signs([names[k] for k in some], bits)
                        votes += weights[at : at + PART_WORDS] @ own_signs.astype(np.float64)
                out[start + row, segments] = _sketch(hashed[own])
                out[start + row, :segments] = (votes > 0).reshape(segments, segment_bits) @ scale
    return out


def _fingerprint_udf(segments: int, segment_bits: int):
    @F.arrow_udf("array<long>")
    def fingerprint(text: pa.Array) -> pa.Array:
        values = fingerprints(text, segments, segment_bits)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * (segments + 1)), pa.array(values.ravel()))

    return fingerprint.asNondeterministic()  # else a pushed filter evaluates it twice


def nodes(docs: DataFrame, id_col: str, text_col: str, segments: int, segment_bits: int) -> DataFrame:
    """(fp, id) of every document with an id and a text that isn't blank."""
    full = docs.where(F.col(id_col).isNotNull() & F.regexp_like(F.col(text_col), F.lit(r"\S")))
    return full.select(F.col(id_col).alias("id"), _fingerprint_udf(segments, segment_bits)(F.col(text_col)).alias("fp"))


def _packed(segments: int, segment_bits: int, fp: str = "fp") -> list:
    """A fingerprint as longs of as many whole segments as fit."""
    per = 63 // segment_bits
    longs = [
        reduce(lambda a, b: F.shiftleft(a, segment_bits).bitwiseOR(b), [F.get(fp, F.lit(k)) for k in range(i, min(i + per, segments))])
        for i in range(0, segments, per)
    ]
    return [*longs, F.coalesce(F.get(fp, F.lit(segments)), F.lit(0).cast("long"))]


def _radii(cost: list[np.ndarray], max_distance: int) -> tuple[float, list[int]]:
    """The cheapest radius of every segment, -1 for none, that misses no pair.

    ``cost[s][r]`` is that of searching segment s up to radius r - 1. If the radii
    plus one add up to ``max_distance`` + 1, a pair that is further apart in every
    segment is further apart in all than ``max_distance``.
    """
    best = np.full(max_distance + 2, np.inf)
    best[0], picks = 0, []
    for c in cost:
        total = np.full((len(c), len(best)), np.inf)
        for r in range(min(len(c), len(best))):
            total[r, r:] = best[: len(best) - r] + c[r]
        picks.append(total.argmin(axis=0))
        best = total.min(axis=0)
    at, radii = len(best) - 1, []
    for pick in reversed(picks):
        radii.append(int(pick[at]) - 1)
        at -= int(pick[at])
    return float(best[-1]), radii[::-1]


class Block:
    """One block of fingerprints: ``words`` of whole segments, the last one a sketch."""

    def __init__(self, names: np.ndarray, words: list[np.ndarray], segments: int, segment_bits: int):
        self.names, self.words, self.bits, self.segment_bits = names, words, segments * segment_bits, segment_bits
        per = 63 // segment_bits
        self.segments = []
        for s in range(segments):
            last = min((s // per + 1) * per, segments) - 1
            self.segments.append(words[s // per] >> (last - s) * segment_bits & ((1 << segment_bits) - 1))

    def part(self, low: int, high: int, rows=slice(None)) -> np.ndarray:
        """The bits from ``low`` to before ``high`` of the whole fingerprint."""
        out, size = np.zeros(len(self.names), np.int64)[rows], self.segment_bits
        for s in range(low // size, -(-high // size)):
            start, stop = max(low, s * size), min(high, (s + 1) * size)
            out = out << (stop - start) | self.segments[s][rows] >> ((s + 1) * size - stop) & ((1 << (stop - start)) - 1)
        return out.astype(np.int32)


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their values, the values, where they start and how often they are."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    found, starts, counts = np.unique(values[order], return_index=True, return_counts=True)
    return order, found, starts.astype(np.int32), counts.astype(np.int32)


def _plan(a: Block, b: Block, max_distance: int) -> list[tuple[int, int, int]]:
    """(first bit, end, radius) of the parts to search, by the cost that a sample of rows shows.

    One empty part, which all rows share, is all pairs.
    """
    rng = np.random.default_rng(0)
    x, y = (rng.choice(len(k.names), min(len(k.names), n), replace=False) for k, n in ((a, 256), (b, 1024)))
    pairs = len(a.names) * len(b.names)
    best, plan = CANDIDATE_COST * pairs, [(0, 0, 0)]
    fewest = -(-a.bits // INDEX_BITS)
    for count in range(fewest, min(fewest + 2, a.bits) + 1):
        ends = [a.bits * k // count for k in range(count + 1)]
        cost = []
        for low, high in zip(ends, ends[1:]):
            near = np.bincount(np.bitwise_count(a.part(low, high, x)[:, None] ^ b.part(low, high, y)).ravel(), minlength=high - low + 1).cumsum() / (len(x) * len(y))
            masks = np.cumsum([comb(high - low, r) for r in range(high - low + 1)])
            cost.append(np.concatenate([[0], CANDIDATE_COST * pairs * near + masks * (len(a.names) + CALL_COST)]))
        total, radii = _radii(cost, min(max_distance, a.bits))
        if total < best:
            best, plan = total, [(low, high, r) for low, high, r in zip(ends, ends[1:], radii) if r >= 0]
    return plan


def _hits(found: np.ndarray, place: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of values of both sides that differ by ``radius`` bits at most."""
    for r in range(radius + 1):
        for chosen in combinations(range(bits), r):
            met = place[found ^ np.int32(sum(1 << k for k in chosen))]
            left = np.flatnonzero(met >= 0)
            if len(left):
                yield left, met[left]


def _together(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _unfolded(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges of numbers one after another, each number with the place of its range; about PAIRS_AT_ONCE at once."""
    ends, low = np.cumsum(counts, dtype=np.int64), 0
    places = np.arange(len(counts), dtype=np.int32)
    while low < len(counts):
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        n = counts[low:high]
        shift = (starts[low:high] - (ends[low:high] - done - n)).astype(np.int32)
        yield np.repeat(places[low:high], n), np.arange(int(ends[high - 1]) - done, dtype=np.int32) + np.repeat(shift, n)
        low = high


def close_rows(a: Block, b: Block, max_distance: int, max_sketch_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of two blocks within both distances, each once."""
    out = [np.empty(0, np.int64)]
    if not len(a.names) or not len(b.names) or max_distance < 0:
        return out[0], out[0]
    for low, high, radius in _plan(a, b, max_distance):
        order, found, starts, counts = _by_value(a.part(low, high))
        order2, found2, starts2, counts2 = _by_value(b.part(low, high))
        place = np.full(1 << (high - low), -1, np.int32)
        place[found2] = np.arange(len(found2))
        mine, theirs = [w[order] for w in a.words], [w[order2] for w in b.words]
        for left, right in _together(_hits(found, place, high - low, radius), PAIRS_AT_ONCE):
            for x, rows in _unfolded(starts[left], counts[left]):  # a value's rows on this side, then the rows that each of them meets
                met = right[x]
                for y, j in _unfolded(starts2[met], counts2[met]):
                    i = rows[y]
                    keep = np.flatnonzero(np.bitwise_count(mine[-1][i] ^ theirs[-1][j]) <= max_sketch_distance)  # few are so close
                    i, j = i[keep], j[keep]
                    apart = sum(np.bitwise_count(m[i] ^ t[j]).astype(np.int64) for m, t in zip(mine[:-1], theirs[:-1]))
                    i, j = i[apart <= max_distance], j[apart <= max_distance]
                    if len(i):
                        out.append(order[i].astype(np.int64) * len(b.names) + order2[j])
    both = np.unique(np.concatenate(out))
    return both // len(b.names), both % len(b.names)


def candidate_pairs(fps: DataFrame, segments: int, segment_bits: int, max_distance: int, max_sketch_distance: int = SKETCH_DISTANCE) -> DataFrame:
    """All pairs (a, b), a < b, of node ids within both distances; ``fps`` has (id, fp), fp unique.

    They are the pairs of which all segments differ by ``max_distance`` bits at
    most and the sketches by ``max_sketch_distance``; none is missed.

    Nodes are written in blocks to the shared folder, and every pair of blocks
    is a task. The result is checkpointed.
    """
    spark = fps.sparkSession
    whole = isinstance(fps.schema["id"].dataType, IntegralType)
    longs = [f"f{i}" for i in range(-(-segments // (63 // segment_bits)) + 1)]
    packed = fps.select("id", *[x.alias(c) for x, c in zip(_packed(segments, segment_bits), longs)])
    if whole:
        packed = packed.withColumn("n", F.col("id").cast("long"))
    else:  # ids of other types go by a number
        packed = stored(packed.withColumn("n", F.monotonically_increasing_id()), "numbered")
    rows = fps.count()
    count = max(-(-rows // BLOCK_ROWS), min(SPREAD, -(-rows // LEAST_ROWS)))
    path = new_path(spark, "blocks")
    blocks = packed.select("n", *longs, F.pmod(F.xxhash64("n"), F.lit(max(1, count))).cast("int").alias("block")).repartition(max(1, count), "block")
    blocks.write.option("compression", "zstd").partitionBy("block").parquet(path)
    tasks = [(i, j) for i in range(count) for j in range(i, count)]

    def run(batches):
        files, root = fs.FileSystem.from_uri(path)
        data = pads.dataset(root, filesystem=files, format="parquet", partitioning=pads.partitioning(pa.schema([("block", pa.int32())]), flavor="hive"))

        def read(block: int) -> Block:
            table = data.to_table(columns=["n", *longs], filter=pc.field("block") == block)
            return Block(table["n"].to_numpy(), [table[c].to_numpy() for c in longs], segments, segment_bits)

        for batch in batches:
            for task in batch.column(0).to_pylist():
                i, j = tasks[task]
                a = read(i)
                b = a if i == j else read(j)
                x, y = close_rows(a, b, max_distance, max_sketch_distance)
                if i == j:
                    x, y = x[x < y], y[x < y]
                x, y = a.names[x], b.names[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    found = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, "a long, b long")
    if whole:
        kind = fps.schema["id"].dataType
        return checkpointed(found.select(F.col("a").cast(kind), F.col("b").cast(kind)))
    for c in ("a", "b"):
        names = packed.select(F.col("n").alias(c), F.col("id").alias(f"id_{c}"))
        found = found.join(names, c)
    return checkpointed(found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")))


def connected(pairs: DataFrame) -> DataFrame:
    """(v, root) for every v that isn't the lowest of its component.

    Large-star and small-star contraction; each round is checkpointed. Rounds
    grow with the logarithm of the longest chain.
    """
    edges = checkpointed(pairs.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("m", "v").alias("m"))
        large = both.where("u > v").join(low, F.col("v") == F.col("w")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), "m")
        joined = large.join(least, F.col("v") == F.col("w")).select("v", "u", "m")
        small = joined.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        edges = checkpointed(small.where("v <> u").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 20)))).first()
        if now == before:
            return edges.select("v", F.col("u").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, segment_bits: int = SEGMENT_BITS, max_distance: int = MAX_DISTANCE, max_sketch_distance: int = SKETCH_DISTANCE) -> DataFrame:
    """(doc_id, duplicate_of) for every document but the first of its group.

    Two documents are linked if their fingerprints differ by ``max_distance``
    bits at most and the sketches of their neighbouring words by
    ``max_sketch_distance`` of SKETCH_BITS bits; no such pair is missed. The
    second keeps apart texts that share their words but not the order of them
    (SKETCH_BITS turns it off). Documents of equal fingerprint and sketch are
    linked. Groups are what links connect; the document with the lowest id of a
    group stands for it.

    Defined cases: rows without an id, and rows with a null, empty or blank
    text, are no one's duplicates. Rows that repeat an id are one document; if
    their texts differ, the groups of all its texts are one. White space doesn't
    count. Texts of any length are read whole. Ids are of any type with an
    order; other columns are not looked at. An empty table gives none.
    """
    all_nodes = stored(nodes(docs, id_col, text_col, segments, segment_bits), "fingerprints")
    same = stored(all_nodes.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    pairs = candidate_pairs(same, segments, segment_bits, max_distance, max_sketch_distance)
    copies = all_nodes.join(same.select(F.col("fp").alias("fp2"), F.col("id").alias("b")), F.col("fp") == F.col("fp2")).where("id <> b")
    links = pairs.unionByName(copies.select(F.col("b").alias("a"), F.col("id").alias("b")))
    return connected(links).select(F.col("v").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` lists."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    (lost,) = fresh(docs, "_gone")
    gone = gone.select(F.col("doc_id").alias(lost))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(lost), "left_anti")

"""Exact line dedup over a corpus that shuffles only suspected repeats.

A first pass hashes every line in the JVM and fills two Bloom filters: one for
hashes seen once, one for hashes seen twice. Each task fills its own pair; the
pairs are merged segment by segment, where a bit of the first filter that two
tasks set becomes a bit of the second. A second pass probes the twice-seen
filter. Lines that it doesn't hold are certainly unique and never move. The
rest are grouped by their whole text, which confirms real repeats and chooses
the first occurrence, so false positives cost a little shuffle and no accuracy.

Sizes: ``bits_per_line`` bits for every line of the input, in a power of two,
up to ``max_filter_bytes`` for a filter, as that is what every executor holds.
With a filter at that bound more lines are suspected; the result is the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import fresh, stored

HASHES = 4
SEGMENT_BITS = 1 << 20
FLUSH_HASHES = 1 << 22
SALTS = 256


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` bits of each hash, by double hashing; shape (HASHES, n)."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)])


def _offsets(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint32)


def _partial_filters(bits: int):
    """Filters of a task's hashes, of FLUSH_HASHES or a batch more at a time."""

    def packed(parts):
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        once = np.unique(positions(found, bits))
        twice = np.unique(positions(found[counts > 1], bits))
        size = min(bits, SEGMENT_BITS)
        for s in range(bits // size):
            lo, hi = np.uint64(s * size), np.uint64((s + 1) * size)
            a = once[np.searchsorted(once, lo) : np.searchsorted(once, hi)] - lo
            if not len(a):
                continue
            b = twice[np.searchsorted(twice, lo) : np.searchsorted(twice, hi)] - lo
            pack = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array(pack[:1], pa.binary()), pa.array(pack[1:], pa.binary())], ["segment", "once", "twice"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            held += len(parts[-1])
            if held >= FLUSH_HASHES:
                yield from packed(parts)
                parts, held = [], 0
        if held:
            yield from packed(parts)

    return run


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist()):
            at = _offsets(a)
            twice[at[once[at]]] = True
            twice[_offsets(b)] = True
            once[at] = True
        packed = np.packbits(twice, bitorder="little").tobytes()
        return pa.table({"segment": table["segment"][:1].cast(pa.int32()), "bits": pa.array([packed], pa.binary())})

    return run


def _line_hashes(text):
    blank = F.lit(r"^\s*$")
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(~F.regexp_like(x, blank), F.xxhash64(x)))


def twice_seen_filter(docs: DataFrame, text: str, bits_per_line: int, max_filter_bytes: int) -> np.ndarray:
    """The merged twice-seen filter as packed bytes; a power of two of bits."""
    lines = docs.agg(F.sum(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = 1 << 12
    while bits < lines * bits_per_line and bits < max_filter_bytes * 8:
        bits *= 2
    hashes = docs.select(F.filter(_line_hashes(F.col(text)), lambda h: h.isNotNull()).alias("h"))
    partial = hashes.mapInArrow(_partial_filters(bits), "segment int, once binary, twice binary")
    size = min(bits, SEGMENT_BITS)
    merged = partial.groupBy("segment").applyInArrow(_merge(size), "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row[0] * size // 8 : (row[0] + 1) * size // 8] = np.frombuffer(row[1], np.uint8)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_line: int = 8, max_filter_bytes: int = 128 << 20, removed_col: str | None = None) -> DataFrame:
    """``docs`` with each repeated line left only where it occurs first.

    Lines are the pieces between newlines, compared exactly. The first
    occurrence is that in the lowest id, then at the lowest line number; later
    ones go, within a document too. All rows and columns stay; a document of
    repeats only keeps an empty text. ``removed_col``, if given, counts what went.

    Defined cases: blank lines (white space only) are never repeats. A null or
    empty text stays as it is. Rows without an id come after all others. Rows
    that repeat an id and text count as further copies: one of them keeps its
    first occurrences, the others lose them. Rows with one id and different
    texts are ordered by a hash of the text. An empty table gives an empty one.
    Any other columns, of whatever name and type, pass through; of copies the
    one with the least other columns counts as first, maps and variants apart.
    """
    spark = docs.sparkSession
    filled = spark.sparkContext.broadcast(twice_seen_filter(docs, text_col, bits_per_line, max_filter_bytes))

    @F.arrow_udf("array<int>")
    def suspects(hashes: pa.Array) -> pa.Array:
        held = filled.value
        bits = len(held) * 8
        lists = hashes.fill_null([]) if hashes.null_count else hashes
        flat = lists.flatten()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        there = ~np.asarray(flat.is_null())
        h = flat.fill_null(0).to_numpy(zero_copy_only=False)
        hit = there
        for p in positions(h, bits):
            hit = hit & ((held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        at = np.flatnonzero(hit)
        owner = np.searchsorted(starts, at, side="right") - 1
        offsets = np.searchsorted(at, starts).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((at - starts[owner]).astype(np.int32)))

    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    suspects = suspects.asNondeterministic()  # else a pushed filter evaluates it twice
    marks, key, copy, later, every, copies, id2, hash2, salt = fresh(docs, "marks", "text_hash", "copy", "later", "every", "copies", "id2", "hash2", "salt")
    marked = docs.withColumn(marks, suspects(_line_hashes(text)))
    where = F.struct(doc.isNull().alias("n"), doc.alias("d"), F.xxhash64(text).alias("t"), F.col("i").alias("i"))
    found = (
        docs.select(doc.alias(id_col), text.alias(text_col), suspects(_line_hashes(text)).alias("s"))
        .where(F.size("s") > 0)
        .select(id_col, text_col, F.split(text, "\n", -1).alias("l"), F.explode("s").alias("i"))
        .select(F.get("l", F.col("i")).alias("line"), where.alias("w"))
    )
    gone = stored(_losses(stored(found, "suspected_lines")), "lost_lines")
    gone = gone.select(*[F.col(a).alias(b) for a, b in (("d", id2), ("t", hash2), ("later", later), ("every", every), ("copies", copies))])
    moved = marked.where(F.size(marks) > 0).drop(marks).withColumn(key, F.xxhash64(text))
    joined = moved.join(gone, doc.eqNullSafe(F.col(id2)) & (F.col(key) == F.col(hash2)), "left").drop(id2, hash2)
    several = F.coalesce(F.col(copies) > 1, F.lit(False))
    numbered = joined.withColumn(copy, F.lit(1))
    if not gone.where(F.col(copies) > 1).isEmpty():
        rest = [F.col(f"`{c}`") for c, t in docs.dtypes if c not in (id_col, text_col) and "map<" not in t and "variant" not in t]
        # copies are first ranked within a salt, so that none of the tasks gets them all
        repeated = stored(joined.where(several).withColumn(salt, F.floor(F.rand(7) * SALTS)), "repeated_rows")
        ranked = repeated.withColumn(copy, F.row_number().over(Window.partitionBy(doc, key, salt).orderBy(*rest, F.lit(0))))
        leaders = ranked.where(F.col(copy) == 1).withColumn(copy, F.row_number().over(Window.partitionBy(doc, key).orderBy(*rest, salt)))
        numbered = numbered.where(~several).unionByName(leaders.unionByName(ranked.where(F.col(copy) > 1)).drop(salt))
    drop = F.when(F.col(copy) == 1, F.col(later)).otherwise(F.col(every))
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)  # by hashing, so long texts take linear time
    kept = F.get(F.transform(F.array(F.struct(lines.alias("l"), left.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n")), F.lit(0))
    short = F.col(every).isNotNull() & (F.size(drop) > 0)

    def columns(new_text, removed):
        return [new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns] + ([removed.cast("int").alias(removed_col)] if removed_col else [])

    changed = numbered.select(*columns(F.when(short, kept).otherwise(text), F.when(short, F.size(drop)).otherwise(0)))
    return marked.where(F.size(marks) == 0).select(*columns(text, F.lit(0))).unionAll(changed)


def _losses(found: DataFrame) -> DataFrame:
    """(d, t, later, every, copies) of each document with repeated lines.

    ``found`` has (line, w), with w the place. ``every`` lists the document's
    repeated lines, ``later`` those of them that occur earlier elsewhere;
    ``copies`` is the number of its equal rows.
    """
    keys = [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(17), F.col("line")).alias("k2")]
    lines = stored(found.groupBy("line").agg(F.min("w").alias("f"), F.count("*").alias("c")).select(*keys, "f", "c"), "lines")
    if lines.groupBy("k1", "k2").count().where("count > 1").isEmpty():
        first = lines.where("c > 1").select(F.col("k1").alias("a"), F.col("k2").alias("b"), "f")
        repeats = found.select(*keys, "w").join(first, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")))
    else:
        first = found.groupBy("line").agg(F.min("w").alias("f"), F.count("*").alias("c")).where("c > 1")
        repeats = found.join(first.select(F.col("line").alias("same"), "f"), F.col("line") == F.col("same"))
    repeats = repeats.select("w", (F.col("w") == F.col("f")).alias("is_first"))
    sets = repeats.groupBy(F.col("w.d").alias("d"), F.col("w.t").alias("t")).agg(
        F.collect_set(F.when(~F.col("is_first"), F.col("w.i"))).alias("later"), F.collect_set("w.i").alias("every"), F.count("*").alias("n")
    )
    return sets.select("d", "t", "later", "every", F.floor(F.col("n") / F.size("every")).alias("copies"))

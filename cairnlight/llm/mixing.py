"""Mixing sources to target weights, in fixed-length blocks.

Every source's texts, in the order of a hash, form one stream of tokens that is
cut into blocks of ``block`` tokens; a separator after each text is a token too.
Output slots come in shards. A shard draws how many slots each source gets, one
multinomial draw; running totals of these counts number a source's slots
through all shards. A pseudorandom permutation of a source's block indices
(swap-or-not rounds, one permutation for each pass over the source) turns these
numbers into blocks, which an equality join on (source, block) fetches. Nothing
is sorted as a whole and no table of random numbers is kept: any slot can be
worked out by itself.

Texts move twice: once to get their offsets, by ranges of the hash that order
them (so that a hot source, and ids of whatever kind, spread over many tasks),
once as block pieces, by the key of the join. Running totals are taken in two
steps, within groups and over groups, so that no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import stored

BLOCK = 512
SHARD = 256
CHUNK_ROWS = 4096
GROUP = 4096
CELLS = 1024
ROUNDS = 24
SEPARATOR = "\n\n"


def _hash60(*parts) -> Column:
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def round_keys(n: Column, *key) -> Column:
    """The keys of one permutation of 0 .. n-1, one for each round."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.pmod(_hash60(*key, r), n))


def permuted(x: Column, n: Column, keys: Column, *key) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n-1."""

    def swap_or_not(at: Column, r: Column) -> Column:
        other = F.pmod(F.get(keys, r - 1) - at, n)
        bit = F.pmod(_hash60(*key, r, F.greatest(at, other)), F.lit(2))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap_or_not)


def running_total(rows: DataFrame, key: str, order: str, value: str, group: int = GROUP) -> DataFrame:
    """``rows`` with ``base``, the sum of ``value`` in rows of the key before it.

    ``order`` is a number from 0, unique for a key. Totals of ``group``
    neighbouring numbers are summed first, so a task gets one group of rows, or
    one row a group.
    """
    rows = rows.withColumn("_part", F.floor(F.col(order) / group).cast("long"))
    before = Window.unboundedPreceding, -1
    parts = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_part2")).agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_key").orderBy("_part2").rowsBetween(*before)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(*before)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(parts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_part2")))
    return rows.withColumn("base", F.col("_before") + F.col("_inside")).drop("_key", "_part", "_part2", "_sum", "_before", "_inside")


def _source(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))


def _tokens(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\n"), F.lit(" \n")), " ", -1)


def _count(text: Column) -> Column:
    """The number of ``_tokens``, without making them, and the separator."""
    return (F.length(text) - F.length(F.translate(text, " \n", "")) + 2).cast("long")


def blocks(docs: DataFrame, block: int = BLOCK, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None, separator=SEPARATOR) -> tuple[DataFrame, DataFrame]:
    """(blocks, totals): rows (src, block, content, n, ids, first) and (src, tokens).

    ``content`` is a text, or an array with ``tokens_col``; ``first`` holds the
    columns of the block's first document but its text.
    """
    doc, data = F.col(f"`{id_col}`"), F.col(f"`{tokens_col or text_col}`")
    usable = F.size(data) > 0 if tokens_col else F.regexp_like(data, F.lit(r"[^ \t\n\r\f\x0B]"))
    digest = F.md5(F.to_json(F.struct(data.alias("t")))) if tokens_col else F.md5(data)
    key = F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit("|"), digest))
    count = (F.size(data) + 1).cast("long") if tokens_col else _count(data)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, tokens_col)])
    rows = docs.where(usable).select(_source(source_col).alias("src"), key.alias("key"), doc.alias("id"), data.alias("data"), count.alias("n"), others.alias("first"))
    bits = max(6, (max(1, docs.count()) // CHUNK_ROWS).bit_length())
    chunk = F.shiftright(F.conv(F.substring("key", 1, 15), 16, 10).cast("long"), 60 - bits)
    rows = rows.withColumn("chunk", chunk)
    chunks = stored(rows.groupBy("src", "chunk").agg(F.sum("n").alias("m")), "chunks")
    bases = running_total(chunks, "src", "chunk", "m").select(F.col("src").alias("src2"), F.col("chunk").alias("chunk2"), "base")
    totals = chunks.groupBy("src").agg(F.sum("m").alias("tokens"))
    inside = Window.partitionBy("src", "chunk").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("o", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(bases, (F.col("src") == F.col("src2")) & (F.col("chunk") == F.col("chunk2"))).withColumn("o", F.col("o") + F.col("base"))
    split = placed.select("src", "id", "first", "o", "n", (F.col("data") if tokens_col else _tokens(F.col("data"))).alias("w"))

    def piece(b: Column) -> Column:
        lo = F.greatest(b * block - F.col("o"), F.lit(0)).cast("int")
        hi = F.least((b + 1) * block - F.col("o"), F.col("n")).cast("int")
        own, ends = F.slice("w", lo + 1, hi - lo), hi == F.col("n")
        if tokens_col:
            made = F.when(ends, F.concat(own, F.array(F.lit(separator)).cast(docs.schema[tokens_col].dataType))).otherwise(own)
        else:
            made = F.concat(F.replace(F.array_join(own, " "), F.lit(" \n"), F.lit("\n")), F.when(ends, F.lit(separator)).otherwise(F.lit("")))
        return F.struct(b.alias("b"), (F.col("o") + lo).alias("at"), (hi - lo).alias("n"), made.alias("t"))

    last = F.floor((F.col("o") + F.col("n") - 1) / block).cast("long")
    pieces = split.select("src", "id", "first", F.explode(F.transform(F.sequence(F.floor(F.col("o") / block).cast("long"), last), piece)).alias("p"))
    packed = pieces.groupBy("src", F.col("p.b").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("p.at").alias("at"), F.col("p.t").alias("t"), "id"))).alias("ps"), F.sum("p.n").alias("n"), F.min_by("first", "p.at").alias("first")
    )
    parts = F.transform("ps", lambda p: p["t"])
    content = F.flatten(parts) if tokens_col else F.array_join(parts, "")
    return packed.select("src", "block", content.alias("content"), F.col("n").cast("long").alias("n"), F.transform("ps", lambda p: p["id"]).alias("ids"), "first"), totals


def slots(totals: DataFrame, block: int, shard: int, seed: int, weights: dict[str | None, int] | None) -> DataFrame:
    """(slot, shard, src, epoch, block): what each output slot holds."""
    spark = totals.sparkSession
    if weights is None:
        weighted = totals.withColumn("w", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("tokens")))).cast("long"))
    else:
        given = spark.createDataFrame([("null" if k is None else f"={k}", int(v)) for k, v in weights.items()], "src2 string, w long")
        weighted = totals.join(given, F.col("src") == F.col("src2")).where("w > 0").select("src", "tokens", "w")
    sized = weighted.withColumn("size", F.ceil(F.col("tokens") / block).cast("long"))
    row = sized.agg(F.sum("size"), F.sum("w"), F.count("*")).first()
    count, weight = row[0] or 0, row[1] or 1
    width = max(1, weight // max(CELLS, row[2]))  # of the cells of weight by which draws and sources meet
    ordered = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sources = sized.withColumn("hi", F.sum("w").over(ordered)).withColumn("lo", F.col("hi") - F.col("w"))
    cells = sources.select("src", "size", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell2"))
    draws = spark.range(count).select(F.floor(F.col("id") / shard).cast("long").alias("shard"), F.pmod(_hash60(seed, "draw", F.col("id")), F.lit(weight)).alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") / width))
    drawn = draws.join(cells, (F.col("cell") == F.col("cell2")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    counts = drawn.groupBy("shard", "src").agg(F.count("*").alias("c"), F.first("size").alias("size"))
    numbered = running_total(counts, "src", "shard", "c").select("shard", "src", "size", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("j"))
    order = Window.partitionBy("shard").orderBy(_hash60(seed, "place", F.col("shard"), F.col("src"), F.col("j")), "src", "j")
    numbered = numbered.withColumn("slot", F.col("shard") * shard + F.row_number().over(order) - 1).withColumn("g", F.col("base") + F.col("j"))
    numbered = numbered.withColumn("epoch", F.floor(F.col("g") / F.col("size")).cast("long"))
    passes = counts.groupBy(F.col("src").alias("src3")).agg(F.sum("c").alias("used"), F.first("size").alias("size3"))
    passes = passes.select("src3", "size3", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("used") - 1) / F.col("size3")).cast("long"))).alias("epoch3"))
    passes = passes.withColumn("keys", round_keys(F.col("size3"), seed, F.col("src3"), F.col("epoch3")))
    keyed = numbered.join(passes, (F.col("src") == F.col("src3")) & (F.col("epoch") == F.col("epoch3")))
    where = permuted(F.pmod("g", "size"), F.col("size"), F.col("keys"), seed, F.col("src"), F.col("epoch"))
    return keyed.select("slot", "shard", "src", "epoch", where.alias("block"))


def mix(docs: DataFrame, *, weights: dict[str | None, int] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None, separator=SEPARATOR) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, doc_id, doc_ids, text, first).

    There are as many slots as blocks in all sources used. ``weights`` are
    integers by source; without them a source weighs the square root of its
    tokens. A source given no weight, or 0, is left out; one with more slots
    than blocks repeats them in passes (``epoch``), each in another order.
    ``doc_ids`` are those of the block's documents in order, ``doc_id`` is the
    first; ``first`` is a struct of that document's columns but its text.

    Tokens are those of the array column ``tokens_col`` (ids from a tokenizer,
    say), and ``text`` is then an array. Without it they are what stands between
    the spaces of a text, where a line break begins a token too; a block joins
    them as they were, so only the space where two blocks meet is left out.
    ``separator`` (a text, or an element of the array) follows each document
    and counts as a token.

    Defined cases: null, empty and blank texts have no tokens and no separator,
    as have null and empty arrays. The last block of a source may be shorter;
    every token is in exactly one block. A null source is a source of its own.
    A source's order is that of md5(id | md5(text)); ids are of any type with a
    text form, and null ids count as empty. Equal rows count each. A text may
    span any number of blocks. An empty table gives none. Columns of whatever
    name only travel in ``first``.
    """
    packed, totals = blocks(docs, block, id_col=id_col, text_col=text_col, source_col=source_col, tokens_col=tokens_col, separator=separator)
    wanted = slots(totals, block, shard, seed, weights).select("slot", "shard", F.col("src").alias("src2"), "epoch", F.col("block").alias("block2"))
    joined = packed.join(wanted, (F.col("src") == F.col("src2")) & (F.col("block") == F.col("block2")))
    source = F.when(F.col("src") != "null", F.substring("src", 2, 1 << 30))
    return joined.select("shard", "slot", source.alias("source"), "epoch", "block", F.col("n").alias("n_tokens"), F.get("ids", F.lit(0)).alias("doc_id"), F.col("ids").alias("doc_ids"), F.col("content").alias("text"), "first")

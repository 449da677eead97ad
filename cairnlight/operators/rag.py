"""Chunks, packing, questions and training rows for retrieval and models."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from . import metrics
from .elements import chunk_candidates


@dataclass(frozen=True)
class RagConfig:
    max_tokens: int = 1000
    include_private: bool = False
    include_tests: bool = False
    least_complexity: int = 0


def chunks(elements: DataFrame, config: RagConfig = RagConfig()) -> DataFrame:
    """One chunk for each element that the filters keep."""
    c = F.col
    content = text.element_content(c("doc_comments"), c("signature"), c("name"))
    df = chunk_candidates(elements, config.include_private, config.least_complexity, config.include_tests).withColumn("content", content)
    return df.select(
        F.concat_ws("_", F.lit("chunk"), "relative_path", "element_id").alias("id"),
        "content",
        text.content_with_context(c("relative_path"), c("module_path"), c("content"), c("complexity")).alias("content_with_context"),
        text.token_estimate(c("content")).alias("token_count"),
        scores.documentation_quality(c("doc_comments"), c("parameter_count")).alias("documentation_quality"),
        scores.semantic_category(c("element_type")).alias("semantic_category"),
        scores.domain_tags(c("name")).alias("domain_tags"),
        scores.intent_tags(c("name"), c("element_type")).alias("intent_tags"),
        scores.embedding_strategy(c("doc_comments"), c("signature")).alias("embedding_strategy"),
        text.keywords(c("name"), c("qualified_name"), c("doc_comments")).alias("retrieval_keywords"),
        text.semantic_hash(c("content")).alias("semantic_hash"),
    )


def embedding_inputs(chunk_rows: DataFrame) -> DataFrame:
    """(id, text): what an embedding model gets, by the chunk's strategy."""
    docs_only = text.documentation_only(F.col("content"))
    chosen = F.when(F.col("embedding_strategy") == "DocumentationOnly", F.when(docs_only == "", F.col("content")).otherwise(docs_only)).when(F.col("embedding_strategy") == "Combined", F.col("content_with_context")).otherwise(F.col("content"))
    return chunk_rows.select("id", chosen.alias("text"))


def duplicates(df: DataFrame, hash_col: str) -> DataFrame:
    return df.groupBy(hash_col).agg(F.count("*").alias("n")).where("n > 1")


def pack(items: DataFrame, tokens: Column, most: int, by: str, order: str) -> DataFrame:
    """(by, chunk, items, tokens): greedy packing of a group's items in order.

    A chunk is closed when the next item would pass ``most`` tokens; an item
    that is larger alone is a chunk of its own. Each step depends on the one
    before, so a group is read in order by one task, of which only order and
    size move and no more than a batch is held.
    """
    rows = items.select(F.col(by).alias("g"), F.col(order).alias("o"), tokens.cast("long").alias("t"))
    ordered = rows.repartition("g").sortWithinPartitions(F.col("g").asc_nulls_first(), F.col("o").asc_nulls_first(), "t").select("g", "t")
    kind = items.schema[by].dataType

    def run(batches):
        group, chunk, count, total, begun = None, 0, 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or 0
                if not begun or g != group:
                    if begun:
                        out.append((group, chunk, count, total))
                    group, chunk, count, total, begun = g, 0, 0, 0, True
                if count and total + t > most:
                    out.append((group, chunk, count, total))
                    chunk, count, total = chunk + 1, 0, 0
                count, total = count + 1, total + t
            if out:
                yield _chunk_rows(out, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if begun:
            yield _chunk_rows([(group, chunk, count, total)], last)

    return ordered.mapInArrow(run, f"`{by}` {kind.simpleString()}, chunk int, items long, tokens long")


def _chunk_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = (kind, pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["g", "chunk", "items", "tokens"])


def chunk_stats(packed: DataFrame, most: int) -> DataFrame:
    """One row: chunks, average items in one, and the share of ``most`` tokens used."""
    df = packed.agg(F.count("*").alias("chunks"), F.coalesce(F.avg("items"), F.lit(0.0)).alias("average_items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return df.withColumn("token_efficiency", F.when((F.col("chunks") > 0) & F.lit(most > 0), F.col("tokens") / (F.col("chunks") * most)).otherwise(0.0))


def chunk_metadata(elements: DataFrame, references: DataFrame | None = None, config: RagConfig = RagConfig()) -> DataFrame:
    """A chunk's place and relations: lines, names, parents, children, references."""
    kept = chunk_candidates(elements, config.include_private, config.least_complexity, config.include_tests)
    parents = F.array(F.coalesce("parent_id", F.lit("")))
    children = elements.where("parent_id IS NOT NULL").groupBy(F.col("relative_path").alias("_p"), F.col("parent_id").alias("_id")).agg(F.sort_array(F.collect_set("element_id")).alias("child_elements"))
    df = kept.join(children, (F.col("relative_path") == F.col("_p")) & (F.col("element_id") == F.col("_id")), "left").drop("_p", "_id")
    none = F.array().cast("array<string>")
    if references is not None:
        known = references.where("is_resolved")
        for end, other, name in (("from_element_id", "to_element_id", "references"), ("to_element_id", "from_element_id", "referenced_by")):
            lists = known.groupBy(F.col(end).alias("_id")).agg(F.sort_array(F.collect_set(other)).alias(name))
            df = df.join(lists, F.col("element_id") == F.col("_id"), "left").drop("_id")
    else:
        df = df.withColumns({"references": none, "referenced_by": none})
    c = F.col
    content = text.element_content(c("doc_comments"), c("signature"), c("name"))
    return df.select(
        F.concat_ws("_", F.lit("chunk"), "relative_path", "element_id").alias("id"), c("relative_path").alias("file_path"), c("line_start").alias("start_line"), c("line_end").alias("end_line"),
        "element_type", c("name").alias("element_name"), "qualified_name", "visibility", text.token_estimate(content).alias("token_count"), "complexity", (F.size("doc_comments") > 0).alias("has_documentation"),
        parents.alias("parent_elements"), *[F.coalesce(n, none).alias(n) for n in ("child_elements", "references", "referenced_by")],
    )


def document_metadata(elements: DataFrame, info: dict[str, str]) -> DataFrame:
    """One row about all elements: token statistics, and how types and complexity spread."""
    content = text.element_content(F.col("doc_comments"), F.col("signature"), F.col("name"))
    stats = metrics.token_stats(elements, text.token_estimate(content)).withColumnRenamed("n", "total_chunks")
    spread = metrics.distribution(elements).groupBy().pivot("dimension", ["type", "complexity"]).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))))
    named = {k: F.lit(info.get(k)) for k in ("name", "version", "rust_edition")}
    return stats.crossJoin(spread.withColumnsRenamed({"type": "element_distribution", "complexity": "complexity_distribution"})).withColumns({**named, "chunk_strategy": F.lit("semantic_boundaries"), "generated_at": F.current_timestamp()})


def document(elements: DataFrame, info: dict[str, str], references: DataFrame | None = None, config: RagConfig = RagConfig(), examples: bool = True) -> dict[str, DataFrame]:
    """The whole retrieval document, by part: metadata, chunks, semantics, examples."""
    rows = chunks(elements, config).join(chunk_metadata(elements, references, config).drop("token_count"), "id")
    parts = {"metadata": document_metadata(elements, info), "chunks": rows, "semantics": metrics.api_surface(elements)}
    return parts | ({"examples": training_examples(elements)} if examples else {})


def code_chunks(elements: DataFrame) -> DataFrame:
    """Chunks for model training: content, context, category, a hint for embedding."""
    c = F.col
    content = text.element_content(c("doc_comments"), c("signature"), c("name"))
    content = F.when(c("signature").isNull(), c("name")).otherwise(content)
    context = F.concat(F.lit("File: "), "relative_path", F.lit(", Module: "), "module_path", F.lit(", Element: "), "name", F.lit(" ("), "element_type", F.lit(")"))
    hint = F.concat(F.lit("Rust "), F.lower("element_type"), F.lit(" "), "name", F.lit(", complexity "), F.coalesce("complexity", F.lit(0)).cast("string"), F.lit(", module "), "module_path")
    category = F.when(c("element_type") == "Function", "function_definition").when(c("element_type").isin("Struct", "Enum"), "data_structure").when(c("element_type") == "Trait", "interface_definition").when(c("element_type") == "Module", "module_organization").otherwise("other")
    return elements.select("element_id", content.alias("content"), context.alias("context"), category.alias("semantic_category"), hint.alias("embedding_hint"), text.token_estimate(content).alias("token_count"))


def dataset_metadata(elements: DataFrame) -> DataFrame:
    """(dimension, bucket, n) of a training set: types, complexity, difficulty of examples."""
    examples = training_examples(elements).groupBy(F.lit("difficulty").alias("dimension"), F.col("difficulty").alias("bucket")).agg(F.count("*").alias("n"))
    return metrics.distribution(elements).unionByName(examples)


def chunk_sizes(chunk_rows: DataFrame) -> DataFrame:
    """(strategy, chunks, tokens_avg, tokens_min, tokens_max) by embedding strategy."""
    return chunk_rows.groupBy("embedding_strategy").agg(F.count("*").alias("chunks"), F.avg("token_count").alias("tokens_avg"), F.min("token_count").alias("tokens_min"), F.max("token_count").alias("tokens_max"))


def training_examples(elements: DataFrame) -> DataFrame:
    c = F.col
    known = c("element_type").isin("Function", "Struct", "Enum", "Trait") & ((c("visibility") == "Public") | (F.size("doc_comments") > 0))
    prompt = F.concat(F.lit("Write a "), F.lower("element_type"), F.lit(" named "), c("name"))
    return elements.where(known).select(
        "element_id", prompt.alias("prompt"), text.element_content(c("doc_comments"), c("signature"), c("name")).alias("completion"),
        scores.difficulty(c("complexity"), c("generic_params"), c("doc_comments")).alias("difficulty"),
        scores.tags(c("element_type"), c("visibility"), c("generic_params"), c("doc_comments"), c("complexity"), c("attributes")).alias("tags"),
    )


def qa_pairs(elements: DataFrame) -> DataFrame:
    """Up to three questions for each documented element."""
    c = F.col
    docs = F.array_join("doc_comments", " ")
    what = F.struct(F.concat(F.lit("What does "), c("name"), F.lit(" do?")).alias("question"), docs.alias("answer"))
    how = F.when(c("visibility") == "Public", F.struct(F.concat(F.lit("How do I use "), c("name"), F.lit("?")).alias("question"), text.usage_example(c("element_type"), c("name")).alias("answer")))
    takes = F.when((c("element_type") == "Function") & (c("parameter_count") > 0), F.struct(F.concat(F.lit("How many parameters does "), c("name"), F.lit(" take?")).alias("question"), c("parameter_count").cast("string").alias("answer")))
    return elements.where(F.size("doc_comments") > 0).select("element_id", F.explode(F.array_compact(F.array(what, how, takes))).alias("q")).select("element_id", "q.question", "q.answer")


def summaries(elements: DataFrame) -> DataFrame:
    fn = F.col("element_type") == "Function"
    return elements.groupBy("element_type").agg(F.count("*").alias("n"), F.count_if(F.col("visibility") == "Public").alias("public"), F.avg(F.when(fn, F.coalesce("complexity", F.lit(0)))).alias("avg_complexity"))

"""Writers: JSON, JSON lines, Markdown, GraphQL SDL, Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "jsonl", "markdown", "graphql", "rag", "messagepack")


def markdown_block() -> Column:
    """One element as Markdown."""
    docs = F.when(F.size("doc_comments") > 0, F.concat(F.lit("\n"), F.array_join("doc_comments", "\n"), F.lit("\n"))).otherwise("")
    code = F.coalesce(F.concat(F.lit("\n```rust\n"), F.col("signature"), F.lit("\n```\n")), F.lit(""))
    return F.concat(F.lit("### "), F.col("name"), F.lit("\n\n**Type:** "), F.col("element_type"), F.lit(" | **Visibility:** "), F.col("visibility"), F.lit("\n"), docs, code)


def markdown(elements: DataFrame, title: str) -> DataFrame:
    """(relative_path, section): a section for each file, in path order.

    The first row, without a path, is the document's head with its contents.
    """
    anchor = F.translate("relative_path", "/.", "")
    blocks = elements.groupBy("relative_path").agg(F.sort_array(F.collect_list(F.struct("ordinal", markdown_block().alias("b")))).alias("bs"))
    sections = blocks.select("relative_path", F.concat(F.lit("## "), F.col("relative_path"), F.lit("\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n")).alias("section"))
    entries = F.concat(F.lit("- ["), F.col("relative_path"), F.lit("](#"), anchor, F.lit(")"))
    head = sections.agg(F.array_join(F.array_sort(F.collect_list(entries)), "\n").alias("c")).select(F.lit(None).cast("string").alias("relative_path"), F.concat(F.lit(f"# {title}\n\n## Contents\n\n"), "c").alias("section"))
    return head.unionByName(sections).orderBy(F.col("relative_path").asc_nulls_first())


def json_rows(df: DataFrame, pretty: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("value"))


def rag_jsonl(chunks: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """A metadata line, then a line for each chunk."""
    spark = chunks.sparkSession
    first = spark.createDataFrame([(0, metadata)], "part int, metadata map<string,string>").select("part", F.to_json(F.struct("metadata")).alias("value"), F.lit("").alias("k"))
    rest = chunks.select(F.lit(1).alias("part"), F.to_json(F.struct("*")).alias("value"), F.col("id").alias("k"))
    return first.unionByName(rest).orderBy("part", "k").select("value")


def graphql_schema(project: str) -> str:
    """The schema of the code model; only the project's name varies."""
    scalar = {"id": "ID!", "name": "String!", "qualifiedName": "String", "signature": "String", "complexity": "Int", "lineStart": "Int", "lineEnd": "Int"}
    fields = "\n".join(f"  {k}: {v}" for k, v in scalar.items())
    kinds = " ".join(("FUNCTION", "STRUCT", "ENUM", "TRAIT", "IMPL", "MODULE"))
    return (
        f"# Code of {project}\n\nenum ElementKind {{ {kinds} }}\n\nenum Visibility {{ PUBLIC RESTRICTED PRIVATE }}\n\n"
        f"type Element {{\n{fields}\n  kind: ElementKind!\n  visibility: Visibility!\n  docs: [String!]!\n  children: [Element!]!\n  references: [Reference!]!\n}}\n\n"
        "type Reference {\n  text: String!\n  target: Element\n}\n\ntype File {\n  path: String!\n  elements: [Element!]!\n}\n\n"
        "type Query {\n  files: [File!]!\n  file(path: String!): File\n  elements(kind: ElementKind, visibility: Visibility): [Element!]!\n}\n"
    )


def pack_messages(value) -> bytes:
    """A value of JSON kinds as MessagePack."""
    import struct

    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        return b"\xd3" + struct.pack(">q", value) if value < 1 << 63 else b"\xcf" + struct.pack(">Q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        head = bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))
        return head + raw
    if isinstance(value, (list, tuple)):
        head = bytes([0x90 | len(value)]) if len(value) < 16 else b"\xdd" + struct.pack(">I", len(value))
        return head + b"".join(map(pack_messages, value))
    head = bytes([0x80 | len(value)]) if len(value) < 16 else b"\xdf" + struct.pack(">I", len(value))
    return head + b"".join(pack_messages(str(k)) + pack_messages(v) for k, v in value.items())


def store(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Write tables as Parquet, partitioned by project."""
    for name, df in tables.items():
        df.write.mode(mode).partitionBy("project_id").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def delete_project(spark: SparkSession, path: str, project_id: str) -> list[str]:
    """Drop a project's partition of every table; returns what was dropped."""
    from urllib.parse import quote

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, dropped = root.getFileSystem(conf), []
    for status in files.listStatus(root):
        part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), f"project_id={quote(project_id)}")
        if files.exists(part):
            files.delete(part, True)
            dropped.append(status.getPath().getName())
    return sorted(dropped)


def reconstruct(elements: DataFrame) -> DataFrame:
    """(project_id, files): each project as one nested row."""
    files = elements.groupBy("project_id", "relative_path").agg(F.sort_array(F.collect_list(F.struct("ordinal", "element_id", "element_type", "name"))).alias("elements"))
    return files.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("relative_path", "elements"))).alias("files"))

"""Reading source trees: discovery, filters, parsing, manifests, documents."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import text
from . import rust

TABLES = {"elements": schemas.ELEMENT_DDL, "references": schemas.REFERENCE_DDL, "imports": schemas.IMPORT_DDL, "files": schemas.FILE_DDL}


@dataclass(frozen=True)
class ExtractOptions:
    include: tuple[str, ...] = ("src/**/*.rs",)
    exclude: tuple[str, ...] = ("target/**", "tests/**")
    max_file_size: int = 10 * 1024 * 1024
    include_private: bool = False
    include_docs: bool = True
    strict_globs: bool = True
    least_success: float = 0.5


class ExtractionError(RuntimeError):
    """Too few files could be parsed."""


def discover(spark: SparkSession, root: str, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """(relative_path, length, content) of the source files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(root)
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace(F.col("path"), rf"^.*?{base.lstrip('/')}/", "")
    files = files.where(F.col("length") <= options.max_file_size).select(relative.alias("relative_path"), "length", "content")
    return files.where(text.path_included("relative_path", list(options.include), list(options.exclude), options.strict_globs))


def parse(files: DataFrame, project_id: str, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """(table, row): all rows of all files as JSON, files with an error included."""
    private, docs = options.include_private, options.include_docs

    def run(batches):
        for batch in batches:
            kinds, rows = [], []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                common = {"project_id": project_id, "relative_path": path}
                row = common | {"size_bytes": len(raw), "lines_of_code": 0, "comment_lines": 0, "error": None}
                try:
                    source = raw.decode("utf-8")
                    row["lines_of_code"], row["comment_lines"] = rust.line_counts(source)
                    found = rust.File(source, rust.module_of(path), private, docs)
                    for kind in ("elements", "references", "imports"):
                        for r in getattr(found, kind):
                            kinds.append(kind)
                            rows.append(json.dumps(common | r))
                except (rust.ParseError, UnicodeDecodeError, IndexError, KeyError, RecursionError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                kinds.append("files")
                rows.append(json.dumps(row))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(rows, pa.string())], ["table", "row"])

    return files.select("relative_path", "content").mapInArrow(run, "table string, row string")


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    return {k: parsed.where(F.col("table") == k).select(F.from_json("row", StructType.fromDDL(ddl)).alias("r")).select("r.*") for k, ddl in TABLES.items()}


def check_success(files: DataFrame, least: float) -> None:
    """Raise unless enough files were parsed; no files at all is fine."""
    row = files.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
    if row["n"] and (row["n"] - row["bad"]) / row["n"] < least:
        raise ExtractionError(f"{row['bad']} of {row['n']} files could not be parsed")


def manifest(spark: SparkSession, path: str, directory: str) -> dict[str, str]:
    """Name, version and edition by a line scan; defaults where they're missing."""
    def field(name: str):
        return F.regexp_extract("value", rf"(?m)^\s*{name} =\s*[\"']?([^\"'\n=]*)", 1)

    try:
        row = spark.read.text(path, wholetext=True).select(*[field(n).alias(n) for n in ("name", "version", "edition")]).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    if row is None:
        return {"name": directory, "version": "0.1.0", "rust_edition": "2021"}
    return {"name": row["name"] or "unknown-project", "version": row["version"] or "0.1.0", "rust_edition": row["edition"] or "2021"}


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Element rows of a project document (one JSON object with files)."""
    element = StructType.fromDDL(schemas.ELEMENT_DDL)
    names = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in element if f.name not in ("project_id", "relative_path"))
    df = spark.read.schema(f"project_id string, files array<struct<relative_path: string, elements: array<struct<{names}>>>>").json(path, multiLine=True)
    df = df.select("project_id", F.explode("files").alias("f")).select("project_id", "f.relative_path", F.explode("f.elements").alias("e"))
    return df.select("project_id", "relative_path", "e.*")


def checksum(content: bytes) -> str:
    return f"{zlib.crc32(content):08x}"

"""Text columns: names, words, token estimates, content of elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def camel_to_snake(s: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(s), r"(?<!^)(\p{Lu})", "_$1"))


def snake_to_camel(s: Column | str) -> Column:
    parts = F.filter(F.split(_c(s), "_"), lambda x: x != "")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))
    return F.concat(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.array_join(rest, ""))


def words(s: Column | str) -> Column:
    return F.filter(F.split(F.lower(_c(s)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(s: Column | str) -> Column:
    return F.ceil(F.octet_length(_c(s)) / 4).cast("long")


def token_estimate_floor(s: Column | str, least: int = 1) -> Column:
    return F.greatest(F.floor(F.octet_length(_c(s)) / 4), F.lit(least)).cast("long")


def element_tokens(name: Column, signature: Column, docs: Column, comments: Column, least: int = 10) -> Column:
    """A token estimate over all text of an element."""
    size = F.octet_length(name) + F.coalesce(F.octet_length(signature), F.lit(0))
    for texts in (docs, comments):
        size = size + F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0), lambda acc, x: acc + F.octet_length(x))
    return F.greatest(F.floor(size / 4), F.lit(least)).cast("long")


def semantic_hash(content: Column | str) -> Column:
    return F.md5(_c(content))


def element_content(docs: Column, signature: Column, name: Column) -> Column:
    return F.concat(F.when(F.size(docs) > 0, F.concat(F.array_join(docs, "\n"), F.lit("\n\n"))).otherwise(""), F.coalesce(signature, name))


def content_with_context(path: Column, module: Column, content: Column, complexity: Column) -> Column:
    tail = F.when(complexity.isNotNull(), F.concat(F.lit("\nComplexity: "), complexity.cast("string"))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\nModule: "), module, F.lit("\n\n"), content, tail)


def keywords(name: Column, qualified: Column, docs: Column, most: int = 20) -> Column:
    """Distinct lower-case names and longer doc words, the first ones in order."""
    doc_words = F.filter(F.split(F.array_join(docs, " "), r"\s+"), lambda w: F.octet_length(w) > 3)
    cleaned = F.transform(doc_words, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    every = F.concat(F.array(F.lower(name), F.lower(qualified)), F.filter(cleaned, lambda w: w != ""))
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(every))), 1, most)


def call_type(text: Column | str) -> Column:
    t = _c(text)
    return F.when(F.contains(t, F.lit("::")), "static").when(F.contains(t, F.lit(".")), "method").otherwise("direct")


def generic_constraints(text: Column | str) -> Column:
    inner = F.regexp_extract(_c(text), r"<([^>]*)>", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def embedding_text(signature: Column, name: Column, docs: Column, kind: Column, visibility: Column) -> Column:
    joined = F.when(F.size(docs) > 0, F.array_join(docs, " "))
    return F.concat_ws("\n", F.coalesce(signature, name), joined, F.concat(F.lit("Type: "), kind), F.concat(F.lit("Visibility: "), visibility))


def documentation_only(content: Column) -> Column:
    """The text of doc-comment lines, joined by spaces."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("///")) | F.startswith(x, F.lit("//!")))
    return F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 4, 1 << 30))), " ")


def anchor(path: Column | str) -> Column:
    return F.translate(_c(path), "/.", "")


def usage_example(kind: Column, name: Column) -> Column:
    return F.when(kind == "Function", F.concat(F.lit("let result = "), name, F.lit("();"))).when(kind.isin("Struct", "Enum"), F.concat(F.lit("let value: "), name, F.lit(" = todo!();"))).otherwise(F.concat(F.lit("use crate::"), name, F.lit(";")))


def element_key(project: Column, path: Column, element_id: Column) -> Column:
    return F.md5(F.concat_ws("|", project, path, element_id))


def path_matches(path: Column | str, pattern: str, strict: bool = False) -> Column:
    """A path filter's pattern: prefix rules by default, real globbing if strict."""
    p = _c(path)
    if strict:
        out, i = "", 0
        while i < len(pattern):
            if pattern[i : i + 3] == "**/":
                out, i = out + "(?:.*/)?", i + 3
            elif pattern[i : i + 2] == "**":
                out, i = out + ".*", i + 2
            else:
                c = pattern[i]
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".+()[]{}|^$\\" else c), i + 1
        return p.rlike(f"^(?:{out})$")
    if "**" in pattern:
        return p.contains(pattern.split("**", 1)[0])
    if pattern.endswith("*"):
        return p.startswith(pattern.rstrip("*"))
    return p.contains(pattern)


def path_included(path: Column | str, include: list[str], exclude: list[str], strict: bool = False) -> Column:
    """Excluding patterns win; then one including pattern must match."""
    keep, drop = F.lit(False), F.lit(False)
    for x in exclude:
        drop = drop | path_matches(path, x, strict)
    for x in include:
        keep = keep | path_matches(path, x, strict)
    return ~drop & keep

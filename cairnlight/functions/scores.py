"""Numeric kernels, classifications and suggestions for elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPENDENCY_STRENGTH = {"FunctionCall": 0.9, "TraitImplementation": 0.8, "TypeUsage": 0.7, "VariableAccess": 0.3}
RELATIONSHIP_STRENGTH = {"implements": 0.9, "extends": 0.8, "uses": 0.6, "contains": 0.7}


def overall_score(cyclomatic: Column, cognitive: Column, nesting: Column, returns: Column) -> Column:
    return F.greatest(F.lit(1), cyclomatic * 2 + cognitive + nesting + returns)


def level(score: Column) -> Column:
    return F.when(score <= 10, "Low").when(score <= 20, "Medium").when(score <= 50, "High").otherwise("VeryHigh")


def band(complexity: Column) -> Column:
    return F.when(complexity <= 2, "Simple").when(complexity <= 5, "Moderate").when(complexity <= 10, "Complex").when(complexity.isNotNull(), "Very Complex")


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """The derived measures of distinct and total operators and operands."""
    vocabulary, length = n1 + n2, total1 + total2
    both = (n1 > 0) & (n2 > 0)
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2 * total2 / n2).otherwise(0.0)
    return {
        "vocabulary": vocabulary, "length": length, "calculated_length": F.when(both, n1 * F.log2(n1) + n2 * F.log2(n2)).otherwise(0.0),
        "volume": volume, "difficulty": difficulty, "effort": difficulty * volume,
    }


def structural(kind: Column, fields: Column, variants: Column, data_variants: Column, methods: Column, types: Column, generics: Column) -> tuple[Column, Column]:
    """Cyclomatic and cognitive numbers of items without a body."""
    cyclomatic = F.when(kind == "Struct", 1 + F.floor(fields / 3) + generics).when(kind == "Enum", variants).when(kind == "Trait", methods + types).when(kind == "Impl", methods).otherwise(1)
    cognitive = F.when(kind == "Struct", F.floor(fields / 2) + generics).when(kind == "Enum", variants + data_variants).when(kind == "Trait", methods * 2 + types).when(kind == "Impl", methods).otherwise(1)
    return cyclomatic.cast("int"), cognitive.cast("int")


def health(documented: Column, complexity: Column) -> Column:
    simple = F.greatest(F.lit(0.0), 1 - F.least(complexity / 50, F.lit(1.0)))
    return F.greatest(F.lit(0.0), F.least(documented * 0.4 + simple * 0.6, F.lit(1.0)))


def health_status(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def quality(complexity: Column, coverage: Column, lines_per_function: Column) -> Column:
    size = F.when(lines_per_function < 20, 30.0).when(lines_per_function < 50, 20.0).otherwise(10.0)
    return F.least(F.lit(100.0), (20 - F.least(complexity, F.lit(20.0))) / 20 * 40 + coverage * 30 + size)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def percentage(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100


def _by(value: Column, table: dict[str, float], other: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(other)


def dependency_strength(reference_type: Column) -> Column:
    return _by(reference_type, DEPENDENCY_STRENGTH, 0.5)


def relationship_strength(relationship: Column) -> Column:
    return _by(relationship, RELATIONSHIP_STRENGTH, 0.5)


def _list(*choices: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, text) for c, text in choices]))


def smells(lines: Column, params: Column, nesting: Column, cyclomatic: Column, cognitive: Column) -> Column:
    return _list((lines > 100, "god_function"), (params > 7, "long_parameter_list"), (nesting > 5, "deep_nesting"), (cognitive > cyclomatic * 2, "cognitive_overload"))


def refactoring(score: Column, lines: Column, params: Column, nesting: Column, cognitive: Column) -> Column:
    hints = _list((lines > 50, "split the function"), (params > 5, "group the parameters"), (nesting > 3, "flatten the nesting"), (cognitive > 15, "simplify the logic"))
    return F.when(score > 20, hints).otherwise(F.array().cast("array<string>"))


def semantic_category(kind: Column) -> Column:
    return F.when(kind == "Function", "behavior").when(kind.isin("Struct", "Enum", "Union"), "data_structure").when(kind == "Trait", "interface").when(kind == "Impl", "implementation").when(kind == "Module", "organization").otherwise("other")


def domain_tags(name: Column) -> Column:
    n = F.lower(name)
    any_of = lambda *parts: n.rlike("|".join(parts))
    return _list((any_of("http", "web", "request"), "web"), (any_of("db", "sql", "query"), "database"), (any_of("async", "future"), "async"), (any_of("test", "mock"), "testing"))


def intent_tags(name: Column, kind: Column) -> Column:
    n = F.lower(name)
    return _list((n.rlike("^(new|create|build)"), "constructor"), (n.rlike("^get"), "getter"), (n.rlike("^set"), "setter"), (n.rlike("^(is|has)"), "predicate"), (kind == "Trait", "contract"), (kind.isin("Struct", "Enum"), "model"))


def documentation_quality(docs: Column, params: Column) -> Column:
    text = F.lower(F.array_join(docs, " "))
    example, long, named = text.contains("example"), F.octet_length(text) > 100, text.contains("param") | text.contains("argument") | (params == 0)
    return F.when(F.size(docs) <= 0, "Missing").when(example & long & named, "Excellent").when(long & (example | named), "Good").otherwise("Basic")


def documentation_score(docs: Column, kind: Column, params: Column) -> Column:
    """The share of checks on its documentation that an element passes."""
    text = F.array_join(docs, " ")
    low, n = F.lower(text), F.octet_length(text)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    format_ok = text.contains("`") | text.contains("#")
    function = (one(n > 20) + one(low.contains("return")) + one(low.contains("param") | (params == 0)) + one(low.contains("example")) + one(format_ok)) / 5
    other = (one(n > 20) + one(n > 50) + one(format_ok)) / 3
    return F.when(F.size(docs) <= 0, 0.0).when(kind == "Function", function).otherwise(other)


def embedding_strategy(docs: Column, signature: Column) -> Column:
    return F.when(F.size(docs) <= 0, "CodeOnly").when(signature.isNull(), "DocumentationOnly").otherwise("Combined")


def missing_doc_priority(visibility: Column) -> Column:
    return F.when(visibility == "Public", "high").when(visibility == "Restricted", "medium").otherwise("low")


def difficulty(complexity: Column, generics: Column, docs: Column) -> Column:
    c = F.coalesce(complexity, F.lit(1))
    return F.when((c <= 2) & (F.size(generics) <= 0), "beginner").when((c <= 5) & (F.size(docs) > 0), "intermediate").when((c > 10) | (F.size(generics) > 0), "advanced").otherwise("intermediate")


def tags(kind: Column, visibility: Column, generics: Column, docs: Column, complexity: Column, attributes: Column) -> Column:
    base = F.array_compact(F.array(F.lower(kind), F.lower(visibility), F.when(F.size(generics) > 0, "generic"), F.when(F.size(docs) > 0, "documented"), F.when(complexity > 5, "complex")))
    return F.concat(base, F.coalesce(attributes, F.array().cast("array<string>")))


def recommendations(documented: Column, complexity: Column) -> Column:
    return _list((documented < 0.5, "document more of the code"), (complexity > 15, "reduce the average complexity"), ((documented >= 0.5) & (complexity <= 15), "keep going"))


def visibility_kind(text: Column) -> Column:
    """Public, Restricted or Private of a visibility's source text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "pub", "Public").when(t.startswith("pub"), "Restricted").otherwise("Private")


def enhancements(kind: Column, docs: Column, signature: Column, quality: Column) -> Column:
    """What an element's documentation lacks."""
    text = F.array_join(docs, " ")
    low, function, sig = F.lower(text), kind == "Function", F.coalesce(signature, F.lit(""))
    return _list(
        (F.octet_length(text) < 20, "say more"),
        (function & ~low.contains("return") & (sig != "") & ~sig.contains("()"), "say what is returned"),
        (function & sig.contains("(") & ~low.contains("param") & ~text.contains("# Arguments"), "name the parameters"),
        (function & ~text.contains("```") & ~text.contains("# Example"), "give an example"),
        (quality < 0.3, "write it anew"),
    )

"""Roll-ups of elements: files, projects, analyzers' metrics, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text

COUNTED = {"function_count": "Function", "struct_count": "Struct", "enum_count": "Enum", "trait_count": "Trait", "module_count": "Module", "impl_count": "Impl"}


def _count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def _docs() -> Column:
    return F.coalesce(F.size("doc_comments"), F.lit(0))


def file_metrics(elements: DataFrame, file_col: str = "relative_path") -> DataFrame:
    counts = [_count_if(F.col("element_type") == kind).alias(name) for name, kind in COUNTED.items()]
    return elements.groupBy(file_col).agg(F.sum(F.coalesce("complexity", F.lit(0))).cast("long").alias("complexity_total"), F.count("*").alias("element_count"), *counts)


def project_metrics(files: DataFrame, *by: str) -> DataFrame:
    """Totals over files; the average weighs types, the maximum is of file sums."""
    totals = [F.sum(c).cast("long").alias(f"total_{c}") for c in COUNTED]
    df = files.groupBy(*by).agg(F.count("*").alias("total_files"), *totals, F.max("complexity_total").alias("complexity_max"), F.sum("complexity_total").cast("long").alias("complexity_sum"), F.sum("element_count").cast("long").alias("total_elements"))
    fn, st, en, tr = (F.col(f"total_{k}_count") for k in ("function", "struct", "enum", "trait"))
    return df.withColumns({"complexity_average_compat": scores.ratio(fn + st + en * 2 + tr * 2, fn + st + en + tr), "complexity_avg": scores.ratio(F.col("complexity_sum"), F.col("total_elements"))})


def distribution(elements: DataFrame) -> DataFrame:
    """(dimension, bucket, n): elements by type and by complexity band."""
    by_type = elements.groupBy(F.lit("type").alias("dimension"), F.col("element_type").alias("bucket")).agg(F.count("*").alias("n"))
    banded = elements.where("complexity IS NOT NULL").groupBy(F.lit("complexity").alias("dimension"), scores.band(F.col("complexity")).alias("bucket")).agg(F.count("*").alias("n"))
    return by_type.unionByName(banded)


def long_metrics(elements: DataFrame) -> DataFrame:
    """(analyzer, metric, value) of the metrics collector, in one aggregation."""
    fn = F.col("element_type") == "Function"
    over = lambda c: F.avg(F.when(fn, F.coalesce(c, F.lit(0))))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    deps = F.coalesce(F.size("dependencies"), F.lit(0))
    values = {
        "total_elements": F.count("*"), **{f"count_{k.lower()}": _count_if(F.col("element_type") == k) for k in ("Function", "Struct", "Enum", "Trait", "Impl", "Module")},
        "function_complexity_avg": over(F.col("complexity")), "function_complexity_max": F.max(F.when(fn, F.col("complexity"))), "function_complexity_min": F.min(F.when(fn, F.col("complexity"))), "function_complexity_total": F.sum(F.when(fn, F.col("complexity"))),
        "avg_cyclomatic": over(F.col("cyclomatic")), "avg_cognitive": over(F.col("cognitive")), "avg_nesting": over(F.col("nesting_depth")), "max_nesting": F.max(F.when(fn, F.col("nesting_depth"))), "avg_lines": over(F.col("lines_of_code")), "avg_parameters": over(F.col("parameter_count")),
        "name_bytes": F.sum(F.octet_length("name")), "signature_bytes": F.sum(F.coalesce(F.octet_length("signature"), F.lit(0))), "avg_name_length": F.avg(F.octet_length("name")), "generic_params": F.sum(F.size("generic_params")),
        **{f"visibility_{v.lower()}": _count_if(F.col("visibility") == v) for v in ("Public", "Restricted", "Private")},
        "documented": _count_if(_docs() > 0), "doc_lines": F.sum(_docs()), "documentation_coverage": share(_docs() > 0), "avg_doc_lines": F.avg(_docs()),
        "dependencies_total": F.sum(deps), "elements_with_dependencies": _count_if(deps > 0), "dependencies_avg": F.avg(deps), "dependencies_max": F.max(deps),
        "attributes_total": F.sum(F.size("attributes")), "distinct_files": F.count_distinct("relative_path"), "elements_per_file": F.count("*") / F.count_distinct("relative_path"),
        "function_ratio": share(fn), "public_ratio": share(F.col("visibility") == "Public"), "complex_ratio": share(F.coalesce("complexity", F.lit(1)) > 10),
        "trait_implementation_ratio": scores.ratio(_count_if(F.col("element_type") == "Impl"), _count_if(F.col("element_type") == "Trait")), "naming_consistency": share(F.contains(F.col("name"), F.lit("_"))),
    }
    row = elements.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in values])).alias("p")
    return row.select(pairs).select(F.lit("metrics").alias("analyzer"), "p.metric", "p.value")


def summary(elements: DataFrame, *by: str) -> DataFrame:
    """Documented ratio, complexity over all elements, health and its status."""
    df = elements.groupBy(*by).agg(F.avg(F.when(_docs() > 0, 1.0).otherwise(0.0)).alias("documentation_ratio"), (F.sum(F.coalesce("complexity", F.lit(0))) / F.count("*")).alias("avg_complexity_over_all"), F.count("*").alias("total_elements"))
    df = df.withColumn("health_score", scores.health(F.col("documentation_ratio"), F.col("avg_complexity_over_all")))
    return df.withColumns({"health_status": scores.health_status(F.col("health_score")), "recommendations": scores.recommendations(F.col("documentation_ratio"), F.col("avg_complexity_over_all"))})


def complexity_report(elements: DataFrame) -> DataFrame:
    """(level, functions, high, very_high): the complexity analyzer's levels."""
    s = scores.overall_score(F.col("cyclomatic"), F.col("cognitive"), F.col("nesting_depth"), F.col("return_count"))
    fn = elements.where("element_type = 'Function'").select(s.alias("s"))
    return fn.groupBy(scores.level(F.col("s")).alias("level")).agg(F.count("*").alias("functions"), F.avg("s").alias("avg_score"), _count_if(F.col("s") > 20).alias("high"), _count_if(F.col("s") > 50).alias("very_high"))


def smells(elements: DataFrame) -> DataFrame:
    """A row for each smell of a function."""
    found = scores.smells(*(F.col(c) for c in ("lines_of_code", "parameter_count", "nesting_depth", "cyclomatic", "cognitive")))
    return elements.where("element_type = 'Function'").select("element_id", "name", F.explode(found).alias("smell"))


def refactorings(elements: DataFrame) -> DataFrame:
    s = scores.overall_score(F.col("cyclomatic"), F.col("cognitive"), F.col("nesting_depth"), F.col("return_count"))
    hints = scores.refactoring(s, *(F.col(c) for c in ("lines_of_code", "parameter_count", "nesting_depth", "cognitive")))
    return elements.where("element_type = 'Function'").select("element_id", "name", F.explode(hints).alias("hint"))


def documentation_by_type(elements: DataFrame) -> DataFrame:
    has, public = _docs() > 0, F.col("visibility") == "Public"
    df = elements.groupBy("element_type").agg(F.count("*").alias("total"), _count_if(has).alias("documented"), _count_if(public).alias("public_total"), _count_if(public & has).alias("public_documented"))
    return df.withColumns({"coverage": scores.ratio(F.col("documented"), F.col("total")), "public_coverage": scores.ratio(F.col("public_documented"), F.col("public_total"))})


def documentation_quality(elements: DataFrame) -> DataFrame:
    score = scores.documentation_score(F.col("doc_comments"), F.col("element_type"), F.col("parameter_count"))
    grade = scores.documentation_quality(F.col("doc_comments"), F.col("parameter_count"))
    return elements.select("element_id", grade.alias("documentation_quality"), score.alias("documentation_score"))


def missing_documentation(elements: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Describe the "), F.lower("element_type"), F.lit(" "), F.col("name"))
    return elements.where(_docs() == 0).select("element_id", "name", scores.missing_doc_priority(F.col("visibility")).alias("priority"), text.alias("suggestion"))


def api_surface(elements: DataFrame) -> DataFrame:
    """Public elements by kind; modules aren't counted in the total."""
    kind = F.when(F.col("element_type") == "Function", "functions").when(F.col("element_type").isin("Struct", "Enum"), "types").when(F.col("element_type") == "Trait", "traits").when(F.col("element_type") == "Module", "modules")
    return elements.where("visibility = 'Public'").select(kind.alias("surface"), "name").where("surface IS NOT NULL").groupBy("surface").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("names"))


def _at_ranks(values: DataFrame, value: str, by: tuple[str, ...], ranks: dict[str, Column]) -> DataFrame:
    """For each group the values at given ranks (from 0, expressions over ``n``).

    Values are counted before they are ranked, so a group is as many rows as it
    has distinct values, and none is collected.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_hi", F.sum("_c").over(order)).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    picked = [F.max(F.when((at >= F.col("_hi") - F.col("_c")) & (at < F.col("_hi")), F.col("_v"))).alias(name) for name, at in ranks.items()]
    return placed.groupBy(*by).agg(*picked)


def token_stats(texts: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """Sum, least, most, mean, upper median and 95th percentile of ``tokens``."""
    values = texts.select(*by, tokens.alias("t"))
    sums = values.groupBy(*by).agg(F.sum("t").alias("tokens_total"), F.min("t").alias("tokens_min"), F.max("t").alias("tokens_max"), F.avg("t").alias("tokens_avg"), F.count("t").alias("n"))
    n = F.col("n")
    ranks = _at_ranks(values, "t", by, {"tokens_median": F.floor(n / 2), "tokens_p95": F.least(F.floor(n * 0.95), n - 1)})
    if not by:
        return sums.crossJoin(ranks)
    keys = ranks.select(*[F.col(c).alias(f"_{c}") for c in by], "tokens_median", "tokens_p95")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sums.join(keys, same, "left").drop(*[f"_{c}" for c in by])


def spread(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, quartiles of the halves without the middle, sample deviation."""
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    ends = {"m1": F.floor((n - 1) / 2), "m2": half, "a1": F.floor((half - 1) / 2), "a2": F.floor(half / 2), "b1": n - half + F.floor((half - 1) / 2), "b2": n - half + F.floor(half / 2)}
    ranks = _at_ranks(values, value, by, {k: F.when(F.lit(k[0] == "m") | (half > 0), v) for k, v in ends.items()})
    deviation = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = deviation.join(ranks.withColumnsRenamed({c: f"_{c}" for c in by}), same)
    return joined.select(*by, *[((F.col(f"{k}1") + F.col(f"{k}2")) / 2).alias(name) for k, name in (("m", "median"), ("a", "q1"), ("b", "q3"))], "stddev")


def file_report(elements: DataFrame) -> DataFrame:
    """Per file: average complexity, public documentation, its three worst issues."""
    public = F.col("visibility") == "Public"
    worst = F.row_number().over(Window.partitionBy("relative_path").orderBy(F.desc("complexity"), "name"))
    issues = elements.where("complexity > 15").select("relative_path", "complexity", "name", worst.alias("k")).where("k <= 3")
    listed = issues.groupBy(F.col("relative_path").alias("_path")).agg(F.sort_array(F.collect_list(F.struct("k", F.concat(F.lit("complex: "), "name").alias("t")))).alias("i"))
    df = elements.groupBy("relative_path").agg(F.avg("complexity").alias("avg_complexity"), _count_if(public).alias("p"), _count_if(public & (_docs() > 0)).alias("d"))
    df = df.join(listed, F.col("relative_path") == F.col("_path"), "left")
    issues = F.coalesce(F.transform("i", lambda x: x["t"]), F.array().cast("array<string>"))
    return df.select("relative_path", "avg_complexity", F.when(F.col("p") == 0, 1.0).otherwise(F.col("d") / F.col("p")).alias("doc_ratio"), issues.alias("issues"))


def _quality() -> Column:
    return scores.documentation_score(F.col("doc_comments"), F.col("element_type"), F.col("parameter_count"))


def documentation_coverage(elements: DataFrame) -> DataFrame:
    """One row: elements, documented ones, their share and their average quality."""
    has = _docs() > 0
    df = elements.agg(F.count("*").alias("total"), _count_if(has).alias("documented"), F.coalesce(F.avg(F.when(has, _quality())), F.lit(0.0)).alias("average_quality"))
    return df.withColumn("coverage", scores.ratio(F.col("documented"), F.col("total")))


def enhancements(elements: DataFrame, least: float = 0.7) -> DataFrame:
    """(element_id, name, quality, suggestions) of documentation under ``least``."""
    rows = elements.where(_docs() > 0).withColumn("quality", _quality()).where(F.col("quality") < least)
    return rows.select("element_id", "name", "quality", scores.enhancements(F.col("element_type"), F.col("doc_comments"), F.col("signature"), F.col("quality")).alias("suggestions"))


def documentation_links(elements: DataFrame) -> DataFrame:
    """(element_id, target, target_id, target_type, target_line) of known dependencies.

    Dependencies are looked up by name; of elements that share one the last counts.
    """
    known = elements.groupBy(F.col("name").alias("target")).agg(F.max_by(F.struct("element_id", "element_type", "line_start"), F.struct("ordinal", "element_id")).alias("x"))
    deps = elements.select("element_id", F.explode("dependencies").alias("target"))
    return deps.join(known, "target").select("element_id", "target", F.col("x.element_id").alias("target_id"), F.col("x.element_type").alias("target_type"), F.col("x.line_start").alias("target_line"))


def documentation_examples(elements: DataFrame) -> DataFrame:
    """(element_id, name, example) of public elements."""
    return elements.where("visibility = 'Public'").select("element_id", "name", text.usage_example(F.col("element_type"), F.col("name")).alias("example"))


def file_records(elements: DataFrame) -> DataFrame:
    """File metrics with the file's name, extension and average over its functions."""
    path = F.col("relative_path")
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("rs")
    df = file_metrics(elements).withColumns({"file_name": name, "extension": extension})
    return df.withColumn("complexity_average", F.col("complexity_total") / F.greatest(F.col("function_count"), F.lit(1)))


def project_record(elements: DataFrame, name: str, version: str) -> DataFrame:
    """One row: a project's totals; what a source tree doesn't tell is null."""
    totals = project_metrics(file_metrics(elements))
    unknown = {c: F.lit(None).cast("string") for c in ("description", "license", "repository_url", "homepage", "readme_path")}
    return totals.withColumns({"name": F.lit(name), "version": F.lit(version), **unknown, "authors": F.array().cast("array<string>")})


def module_report(elements: DataFrame, references: DataFrame) -> DataFrame:
    """(dimension, bucket, n): modules and kinds of references, counted."""
    modules = elements.groupBy(F.lit("module").alias("dimension"), F.col("module_path").alias("bucket")).agg(F.count("*").alias("n"))
    kinds = references.groupBy(F.lit("reference").alias("dimension"), F.col("reference_type").alias("bucket")).agg(F.count("*").alias("n"))
    return modules.unionByName(kinds)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))

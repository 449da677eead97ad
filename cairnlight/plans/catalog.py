"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import graph, metrics, rag, search
from ..operators import elements as el
from . import views
from ..schemas import TRAVERSALS
from .views import C, E, R, T, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most complex elements."""
    return q_elements_filtered(spark, sf_dir)


SHOWN = "element_id, element_type, name, visibility, complexity"


@query(f"""WITH {E} SELECT {SHOWN} FROM e WHERE project_id = 'p' AND element_type IN ('Function', 'Struct') AND visibility = 'Public'
AND complexity BETWEEN 10 AND 45 AND name ILIKE '%e%' ORDER BY complexity DESC, name, element_id LIMIT 10""")
def q_elements_filtered(spark, sf_dir):
    q = el.ElementQuery(views.elements(spark, sf_dir)).project("p").types("Function", "Struct").visibility("Public").complexity_between(10, 45).name_like("e")
    return q.order_by("complexity", True).order_by("name").order_by("element_id").limit(10).run().select(*SHOWN.split(", "))


@query(f"WITH {E} SELECT {SHOWN} FROM e WHERE project_id = 'p' AND name ILIKE '%RED%'")
def q_elements_by_name_ilike(spark, sf_dir):
    return el.ElementQuery(views.elements(spark, sf_dir)).project("p").name_like("RED").run().select(*SHOWN.split(", "))


@query(f"WITH {E} SELECT {SHOWN} FROM e WHERE coalesce(complexity, 1) > 40")
def q_high_complexity(spark, sf_dir):
    return el.ElementQuery(views.elements(spark, sf_dir)).more_complex_than(40).run().select(*SHOWN.split(", "))


@query(f"WITH {E} SELECT {SHOWN} FROM e WHERE visibility = 'Public' AND len(doc_comments) > 0")
def q_public_documented(spark, sf_dir):
    return el.ElementQuery(views.elements(spark, sf_dir)).public().documented().run().select(*SHOWN.split(", "))


@query(f"""WITH {E} SELECT {SHOWN} FROM e WHERE len(list_filter(attributes, lambda a: contains(a, 'test'))) > 0
AND list_contains(dependencies, module_path) AND line_start >= 10 AND line_end <= 100000""")
def q_attribute_dependency_lines(spark, sf_dir):
    q = el.ElementQuery(views.elements(spark, sf_dir)).with_attribute("test").with_dependencies().where(F.array_contains("dependencies", F.col("module_path")))
    return q.in_lines(10, 100000).run().select(*SHOWN.split(", "))


@query(f"""WITH {E} SELECT element_id, visibility = 'Public' AS is_public, len(list_filter(attributes, lambda a: contains(a, 'test'))) > 0 AS is_test,
len(list_filter(attributes, lambda a: contains(a, 'deprecated'))) > 0 AS is_deprecated, starts_with(coalesce(signature, ''), 'async ') AS is_async, starts_with(coalesce(signature, ''), 'unsafe ') AS is_unsafe FROM e""")
def q_element_flags(spark, sf_dir):
    return views.elements(spark, sf_dir).select("element_id", *[c.alias(n) for n, c in el.flags().items()])


FILES = """f AS (SELECT relative_path, CAST(sum(coalesce(complexity, 0)) AS BIGINT) AS complexity_total, count(*) AS element_count,
  count(*) FILTER (WHERE element_type = 'Function') AS function_count, count(*) FILTER (WHERE element_type = 'Struct') AS struct_count,
  count(*) FILTER (WHERE element_type = 'Enum') AS enum_count, count(*) FILTER (WHERE element_type = 'Trait') AS trait_count,
  count(*) FILTER (WHERE element_type = 'Module') AS module_count, count(*) FILTER (WHERE element_type = 'Impl') AS impl_count FROM e GROUP BY relative_path)"""


@query(f"WITH {E}, {FILES} SELECT * FROM f")
def q_file_metrics(spark, sf_dir):
    return metrics.file_metrics(views.elements(spark, sf_dir))


@query(f"""WITH {E}, {FILES}, t AS (SELECT count(*) AS total_files, CAST(sum(function_count) AS BIGINT) AS total_function_count, CAST(sum(struct_count) AS BIGINT) AS total_struct_count,
 CAST(sum(enum_count) AS BIGINT) AS total_enum_count, CAST(sum(trait_count) AS BIGINT) AS total_trait_count, CAST(sum(module_count) AS BIGINT) AS total_module_count,
 CAST(sum(impl_count) AS BIGINT) AS total_impl_count, max(complexity_total) AS complexity_max, CAST(sum(complexity_total) AS BIGINT) AS complexity_sum, CAST(sum(element_count) AS BIGINT) AS total_elements FROM f)
SELECT *, round((total_function_count + total_struct_count + 2 * total_enum_count + 2 * total_trait_count) / (total_function_count + total_struct_count + total_enum_count + total_trait_count), 9) AS complexity_average_compat,
 round(complexity_sum / total_elements, 9) AS complexity_avg FROM t""")
def q_project_metrics(spark, sf_dir):
    df = metrics.project_metrics(metrics.file_metrics(views.elements(spark, sf_dir)))
    return df.withColumns({c: F.round(c, 9) for c in ("complexity_average_compat", "complexity_avg")})


@query(f"""WITH {E} SELECT 'type' AS dimension, element_type AS bucket, count(*) AS n FROM e GROUP BY element_type
UNION ALL SELECT 'complexity', CASE WHEN complexity <= 2 THEN 'Simple' WHEN complexity <= 5 THEN 'Moderate' WHEN complexity <= 10 THEN 'Complex' ELSE 'Very Complex' END, count(*)
FROM e WHERE complexity IS NOT NULL GROUP BY 2""")
def q_element_distribution(spark, sf_dir):
    return metrics.distribution(views.elements(spark, sf_dir))


SCORE = "greatest(1, 2 * cyclomatic + cognitive + nesting_depth + return_count)"


@query(f"""WITH {E}, s AS (SELECT {SCORE} AS s FROM e WHERE element_type = 'Function')
SELECT CASE WHEN s <= 10 THEN 'Low' WHEN s <= 20 THEN 'Medium' WHEN s <= 50 THEN 'High' ELSE 'VeryHigh' END AS level, count(*) AS functions, round(avg(s), 9) AS avg_score,
 count(*) FILTER (WHERE s > 20) AS high, count(*) FILTER (WHERE s > 50) AS very_high FROM s GROUP BY 1""")
def q_complexity_levels(spark, sf_dir):
    return metrics.complexity_report(views.elements(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 9))


LONG = {
    "total_elements": "count(*)", **{f"count_{k.lower()}": f"count(*) FILTER (WHERE element_type = '{k}')" for k in ("Function", "Struct", "Enum", "Trait", "Impl", "Module")},
    **{f"function_complexity_{n}": f"{f}(complexity) FILTER (WHERE element_type = 'Function')" for n, f in (("avg", "avg"), ("max", "max"), ("min", "min"), ("total", "sum"))},
    **{n: f"{f}({c}) FILTER (WHERE element_type = 'Function')" for n, f, c in (("avg_cyclomatic", "avg", "cyclomatic"), ("avg_cognitive", "avg", "cognitive"), ("avg_nesting", "avg", "nesting_depth"), ("max_nesting", "max", "nesting_depth"), ("avg_lines", "avg", "lines_of_code"), ("avg_parameters", "avg", "parameter_count"))},
    "name_bytes": "sum(strlen(name))", "signature_bytes": "sum(coalesce(strlen(signature), 0))", "avg_name_length": "avg(strlen(name))", "generic_params": "sum(len(generic_params))",
    **{f"visibility_{v.lower()}": f"count(*) FILTER (WHERE visibility = '{v}')" for v in ("Public", "Restricted", "Private")},
    "documented": "count(*) FILTER (WHERE len(doc_comments) > 0)", "doc_lines": "sum(len(doc_comments))", "documentation_coverage": "avg(CASE WHEN len(doc_comments) > 0 THEN 1.0 ELSE 0 END)", "avg_doc_lines": "avg(len(doc_comments))",
    "dependencies_total": "sum(len(dependencies))", "elements_with_dependencies": "count(*) FILTER (WHERE len(dependencies) > 0)", "dependencies_avg": "avg(len(dependencies))", "dependencies_max": "max(len(dependencies))",
    "attributes_total": "sum(len(attributes))", "distinct_files": "count(DISTINCT relative_path)", "elements_per_file": "count(*) / count(DISTINCT relative_path)",
    "function_ratio": "avg(CASE WHEN element_type = 'Function' THEN 1.0 ELSE 0 END)", "public_ratio": "avg(CASE WHEN visibility = 'Public' THEN 1.0 ELSE 0 END)", "complex_ratio": "avg(CASE WHEN coalesce(complexity, 1) > 10 THEN 1.0 ELSE 0 END)",
    "trait_implementation_ratio": "CASE WHEN count(*) FILTER (WHERE element_type = 'Trait') = 0 THEN 0 ELSE count(*) FILTER (WHERE element_type = 'Impl') / count(*) FILTER (WHERE element_type = 'Trait') END",
    "naming_consistency": "avg(CASE WHEN contains(name, '_') THEN 1.0 ELSE 0 END)",
}


@query(f"WITH {E} " + " UNION ALL ".join(f"SELECT 'metrics' AS analyzer, '{k}' AS metric, round(CAST({v} AS DOUBLE), 9) AS value FROM e" for k, v in LONG.items()))
def q_metrics_long(spark, sf_dir):
    return metrics.long_metrics(views.elements(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(f"""WITH {E} SELECT visibility, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 9) AS ratio FROM e GROUP BY visibility""")
def q_visibility_ratios(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    total = e.agg(F.count("*").alias("t"))
    return e.groupBy("visibility").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("visibility", "n", F.round(F.col("n") / F.col("t"), 9).alias("ratio"))


@query(f"""WITH {E}, t AS (SELECT element_type, count(*) AS total, count(*) FILTER (WHERE len(doc_comments) > 0) AS documented, count(*) FILTER (WHERE visibility = 'Public') AS public_total,
 count(*) FILTER (WHERE visibility = 'Public' AND len(doc_comments) > 0) AS public_documented FROM e GROUP BY element_type)
SELECT *, round(documented / total, 9) AS coverage, round(CASE WHEN public_total = 0 THEN 0 ELSE public_documented / public_total END, 9) AS public_coverage FROM t""")
def q_doc_coverage_by_type(spark, sf_dir):
    return metrics.documentation_by_type(views.elements(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("coverage", "public_coverage")})


@query(f"""WITH {E}, x AS (SELECT element_id, element_type = 'Function' AS fn, parameter_count AS p, len(doc_comments) AS k, array_to_string(doc_comments, ' ') AS t FROM e),
y AS (SELECT *, strlen(t) AS n, lower(t) AS w, contains(lower(t), 'example') AS ex, contains(lower(t), 'param') OR contains(lower(t), 'argument') OR p = 0 AS pa FROM x)
SELECT element_id, CASE WHEN k = 0 THEN 'Missing' WHEN ex AND n > 100 AND pa THEN 'Excellent' WHEN n > 100 AND (ex OR pa) THEN 'Good' ELSE 'Basic' END AS documentation_quality,
 round(CASE WHEN k = 0 THEN 0.0 WHEN fn THEN (CAST(n > 20 AS INT) + CAST(contains(w, 'return') AS INT) + CAST(contains(w, 'param') OR p = 0 AS INT) + CAST(ex AS INT) + CAST(contains(t, '`') OR contains(t, '#') AS INT)) / 5
 ELSE (CAST(n > 20 AS INT) + CAST(n > 50 AS INT) + CAST(contains(t, '`') OR contains(t, '#') AS INT)) / 3 END, 9) AS documentation_score FROM y""")
def q_documentation_quality(spark, sf_dir):
    return metrics.documentation_quality(views.elements(spark, sf_dir)).withColumn("documentation_score", F.round("documentation_score", 9))


@query(f"""WITH {E} SELECT element_id, name, CASE visibility WHEN 'Public' THEN 'high' WHEN 'Restricted' THEN 'medium' ELSE 'low' END AS priority,
 'Describe the ' || lower(element_type) || ' ' || name AS suggestion FROM e WHERE len(doc_comments) = 0""")
def q_missing_documentation(spark, sf_dir):
    return metrics.missing_documentation(views.elements(spark, sf_dir))


@query(f"""WITH {E}, t AS (SELECT relative_path, avg(CASE WHEN len(doc_comments) > 0 THEN 1.0 ELSE 0 END) AS d, sum(coalesce(complexity, 0)) / count(*) AS c, count(*) AS total_elements FROM e GROUP BY relative_path),
h AS (SELECT *, greatest(0, least(1, 0.4 * d + 0.6 * greatest(0, 1 - least(c / 50, 1)))) AS h FROM t)
SELECT relative_path, round(d, 9) AS documentation_ratio, round(c, 9) AS avg_complexity_over_all, total_elements, round(h, 9) AS health_score,
 CASE WHEN h >= .8 THEN 'excellent' WHEN h >= .6 THEN 'good' WHEN h >= .4 THEN 'fair' ELSE 'poor' END AS health_status,
 array_to_string(list_filter([CASE WHEN d < .5 THEN 'document more of the code' END, CASE WHEN c > 15 THEN 'reduce the average complexity' END, CASE WHEN d >= .5 AND c <= 15 THEN 'keep going' END], lambda x: x IS NOT NULL), ';') AS recommendations FROM h""")
def q_health_score(spark, sf_dir):
    return metrics.summary(views.elements(spark, sf_dir), "relative_path").withColumn("recommendations", F.array_join("recommendations", ";")).withColumns({c: F.round(c, 9) for c in ("documentation_ratio", "avg_complexity_over_all", "health_score")})


@query("""WITH t AS (SELECT o_orderpriority, avg(l_quantity) AS c, avg(l_discount) AS d, count(*) / count(DISTINCT o_orderkey) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderpriority, round(least(100, 40 * (20 - least(c, 20)) / 20 + 30 * d + CASE WHEN s < 20 THEN 30 WHEN s < 50 THEN 20 ELSE 10 END), 6) AS quality_score FROM t""")
def q_quality_score(spark, sf_dir):
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority")
    t = t.agg(F.avg("l_quantity").alias("c"), F.avg("l_discount").alias("d"), (F.count("*") / F.count_distinct("o_orderkey")).alias("s"))
    return t.select("o_orderpriority", F.round(scores.quality(F.col("c"), F.col("d"), F.col("s")), 6).alias("quality_score"))


@query(f"""WITH {E}, x AS (SELECT * FROM e WHERE element_type = 'Function') SELECT element_id, name, 'god_function' AS smell FROM x WHERE lines_of_code > 100
UNION ALL SELECT element_id, name, 'long_parameter_list' FROM x WHERE parameter_count > 7 UNION ALL SELECT element_id, name, 'deep_nesting' FROM x WHERE nesting_depth > 5
UNION ALL SELECT element_id, name, 'cognitive_overload' FROM x WHERE cognitive > 2 * cyclomatic""")
def q_code_smells(spark, sf_dir):
    return metrics.smells(views.elements(spark, sf_dir))


@query(f"""WITH {E}, x AS (SELECT * FROM e WHERE element_type = 'Function' AND {SCORE} > 20) SELECT element_id, name, 'split the function' AS hint FROM x WHERE lines_of_code > 50
UNION ALL SELECT element_id, name, 'group the parameters' FROM x WHERE parameter_count > 5 UNION ALL SELECT element_id, name, 'flatten the nesting' FROM x WHERE nesting_depth > 3
UNION ALL SELECT element_id, name, 'simplify the logic' FROM x WHERE cognitive > 15""")
def q_refactorings(spark, sf_dir):
    return metrics.refactorings(views.elements(spark, sf_dir))


WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), k AS (SELECT doc_id, len(list_distinct(w)) AS n1, len(w) AS t1, len(list_distinct(list_transform(w, lambda x: length(x)))) AS n2 FROM w)
SELECT doc_id, n1 + n2 AS vocabulary, 2 * t1 AS length, round(CASE WHEN n1 > 0 AND n2 > 0 THEN n1 * log2(n1) + n2 * log2(n2) ELSE 0 END, 6) AS calculated_length,
 round(CASE WHEN n1 + n2 > 0 THEN 2 * t1 * log2(n1 + n2) ELSE 0 END, 6) AS volume, round(CASE WHEN n2 > 0 THEN n1 / 2 * t1 / n2 ELSE 0 END, 6) AS difficulty FROM k""")
def q_halstead(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", text.words("text").alias("w"))
    n1, n2 = F.size(F.array_distinct("w")), F.size(F.array_distinct(F.transform("w", lambda x: F.length(x))))
    m = scores.halstead(F.col("n1"), F.col("n2"), F.col("t1"), F.col("t1"))
    df = w.select("doc_id", n1.alias("n1"), n2.alias("n2"), F.size("w").alias("t1"))
    return df.select("doc_id", *[(m[k].cast("long") if k in ("vocabulary", "length") else F.round(m[k], 6)).alias(k) for k in ("vocabulary", "length", "calculated_length", "volume", "difficulty")])


@query("""WITH t AS (SELECT lang, CAST(ceil(strlen(text) / 4) AS BIGINT) AS t FROM documents), s AS (SELECT lang, count(*) AS n, list_sort(list(t)) AS s, CAST(sum(t) AS BIGINT) AS tokens_total, min(t) AS tokens_min, max(t) AS tokens_max, avg(t) AS a FROM t GROUP BY lang)
SELECT lang, tokens_total, tokens_min, tokens_max, round(a, 6) AS tokens_avg, n, s[CAST(floor(n / 2) AS INT) + 1] AS tokens_median, s[CAST(least(floor(n * .95), n - 1) AS INT) + 1] AS tokens_p95 FROM s""")
def q_token_stats(spark, sf_dir):
    df = metrics.token_stats(table(spark, sf_dir, "documents"), text.token_estimate("text"), "lang")
    return df.withColumn("tokens_avg", F.round("tokens_avg", 6))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n, coalesce(stddev_samp(value), 0) AS d FROM events WHERE value IS NOT NULL GROUP BY event_type),
h AS (SELECT *, s[1 : n // 2] AS lo, s[n - n // 2 + 1 : n] AS hi, n // 2 AS m FROM s)
SELECT event_type, round((s[(n + 1) // 2] + s[n // 2 + 1]) / 2, 6) AS median, round((lo[(m + 1) // 2] + lo[m // 2 + 1]) / 2, 6) AS q1, round((hi[(m + 1) // 2] + hi[m // 2 + 1]) / 2, 6) AS q3, round(d, 6) AS stddev FROM h""")
def q_quartiles_median(spark, sf_dir):
    df = metrics.spread(table(spark, sf_dir, "events"), "value", "event_type")
    return df.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3", "stddev")])


@query(f"""WITH {E}, {R}, c AS (SELECT * FROM refs WHERE reference_type = 'FunctionCall' AND from_element_id IN (SELECT element_id FROM e WHERE element_type = 'Function') AND to_element_id IN (SELECT element_id FROM e WHERE element_type = 'Function'))
SELECT from_element_id AS src, to_element_id AS dst, arg_min(CASE WHEN contains(reference_text, '::') THEN 'static' WHEN contains(reference_text, '.') THEN 'method' ELSE 'direct' END, (line, reference_text)) AS call_type,
 count(*) AS call_count, array_to_string(list_sort(list(line)), ',') AS call_sites, from_element_id = to_element_id AS is_recursive FROM c GROUP BY 1, 2""")
def q_call_chains(spark, sf_dir):
    df = graph.call_edges(views.references(spark, sf_dir), views.elements(spark, sf_dir))
    return df.withColumn("call_sites", F.array_join(F.col("call_sites").cast("array<string>"), ","))


@query(f"""WITH {E}, {R} SELECT from_element_id AS src, to_element_id AS dst, reference_type AS dependency_type, count(*) AS n, CASE reference_type WHEN 'TypeUsage' THEN 0.7 ELSE 0.3 END::DOUBLE AS strength, true AS is_direct
FROM refs WHERE reference_type IN ('TypeUsage', 'VariableAccess') AND from_element_id IN (SELECT element_id FROM e) AND to_element_id IN (SELECT element_id FROM e) GROUP BY 1, 2, 3""")
def q_dependency_edges(spark, sf_dir):
    return graph.dependency_edges(views.references(spark, sf_dir), views.elements(spark, sf_dir))


@query(f"""WITH {E}, {R}, t AS (SELECT element_id FROM e WHERE element_type IN ('Struct', 'Enum', 'Trait'))
SELECT DISTINCT from_element_id AS src, to_element_id AS dst, 'uses' AS rel_type, CAST(0.6 AS DOUBLE) AS strength, '' AS generic_constraints FROM refs WHERE reference_type = 'TypeUsage' AND from_element_id IN (SELECT * FROM t) AND to_element_id IN (SELECT * FROM t)""")
def q_type_edges(spark, sf_dir):
    return graph.type_edges(views.references(spark, sf_dir), views.elements(spark, sf_dir)).withColumn("generic_constraints", F.array_join("generic_constraints", ",")).distinct()


@query(f"""WITH {C} SELECT c.src, c.dst, c.call_count, a.p_name AS src_name, b.p_name AS dst_name FROM calls c JOIN part a ON a.p_partkey = c.src JOIN part b ON b.p_partkey = c.dst""")
def q_call_graph_view(spark, sf_dir):
    return graph.named(views.calls(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey", "p_name").select("src", "dst", "call_count", "src_name", "dst_name")


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS files FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def q_project_summary(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("files"))


@query(f"""WITH {E}, {C} SELECT e.element_id, coalesce(array_to_string(list_sort(list(CAST(dst AS VARCHAR)) FILTER (WHERE dst IS NOT NULL)), ','), '') AS targets FROM e LEFT JOIN calls ON src = key GROUP BY 1""")
def q_elements_with_relationships(spark, sf_dir):
    edges = views.calls(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("call").alias("kind"), F.lit("direct").alias("rel_type"))
    df = el.ElementQuery(views.elements(spark, sf_dir)).with_relationships(edges).run()
    return df.select("element_id", F.coalesce(F.array_join(F.array_sort(F.transform("relationships", lambda r: r["dst"])), ","), F.lit("")).alias("targets"))


@query(f"""WITH RECURSIVE {T}, h AS (SELECT id, parent, name, 0 AS depth, name AS path FROM tree WHERE parent IS NULL
UNION ALL SELECT t.id, t.parent, t.name, h.depth + 1, h.path || '/' || t.name FROM h JOIN tree t ON t.parent = h.id) SELECT * FROM h""")
def q_hierarchy(spark, sf_dir):
    return graph.hierarchy(views.tree(spark, sf_dir)).withColumn("path", F.array_join("path", "/"))


@query(f"WITH {T} SELECT p.id, array_to_string(list_sort(list(c.id) FILTER (WHERE c.id IS NOT NULL)), ',') AS children FROM tree p LEFT JOIN tree c ON c.parent = p.id GROUP BY p.id")
def q_children(spark, sf_dir):
    t = views.tree(spark, sf_dir)
    rows = t.select(F.lit("f").alias("relative_path"), F.col("id").alias("element_id"), F.col("parent").alias("parent_id"), F.col("id").alias("ordinal"))
    return el.children(rows).select(F.col("element_id").alias("id"), F.when(F.size("children_ids") > 0, F.array_join("children_ids", ",")).alias("children"))


START = "s AS (SELECT src AS node FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def _start(calls: DataFrame) -> DataFrame:
    """The vertex with the most edges, ties by id."""
    return calls.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))


def _stored_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = graph._checkpointed(views.calls(spark, sf_dir))
    return calls, graph._checkpointed(_start(calls))


def _walk(step: str, depth: int | None) -> str:
    a, b = step.split(">")
    within = "" if depth is None else f"w.depth < {depth} AND "
    return f"""w AS (SELECT node, 0 AS depth, [node] AS path FROM s UNION ALL SELECT c.{b}, w.depth + 1, list_append(w.path, c.{b}) FROM w JOIN calls c ON c.{a} = w.node
 WHERE {within}NOT list_contains(w.path, c.{b}))"""


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', 4)} SELECT node, depth, array_to_string(path, '>') AS path FROM w")
def q_dependency_tree(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.paths(calls, start, 4).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {C}, s AS (SELECT dst AS node FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), {_walk('dst>src', 3)} SELECT node, depth, array_to_string(path, '>') AS path FROM w")
def q_call_tree_backward(spark, sf_dir):
    calls = graph._checkpointed(graph.reversed_edges(views.calls(spark, sf_dir)))
    return graph.paths(calls, graph._checkpointed(_start(calls)), 3).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', 4)} SELECT node, min(depth) AS depth FROM w GROUP BY node")
def q_bfs_levels(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.levels(calls, start, 4).select("node", "depth")


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', 3)} SELECT c.src, c.dst, min(w.depth) + 1 AS depth FROM w JOIN calls c ON c.src = w.node WHERE w.depth < 3 GROUP BY 1, 2")
def q_find_dependents(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.discovered_edges(calls, start, 3)


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', None)} SELECT node, depth, array_to_string(path, '>') AS path FROM w")
def q_dependency_tree_whole(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.paths(calls, start, None).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {C}, s AS (SELECT dst AS node FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), {_walk('dst>src', None)} SELECT node, depth, array_to_string(path, '>') AS path FROM w")
def q_call_tree_backward_whole(spark, sf_dir):
    calls = graph._checkpointed(graph.reversed_edges(views.calls(spark, sf_dir)))
    return graph.paths(calls, graph._checkpointed(_start(calls)), None).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', None)} SELECT node, min(depth) AS depth FROM w GROUP BY node")
def q_bfs_levels_whole(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.levels(calls, start, None).select("node", "depth")


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', None)} SELECT c.src, c.dst, min(w.depth) + 1 AS depth FROM w JOIN calls c ON c.src = w.node GROUP BY 1, 2")
def q_find_dependents_whole(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.discovered_edges(calls, start, None)


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', 12)} SELECT node, CAST(min(depth) AS DOUBLE) AS distance, array_to_string(min(path) FILTER (WHERE depth = m), '>') AS path, CAST(min(depth) AS INT) AS edge_count FROM (SELECT *, min(depth) OVER (PARTITION BY node) AS m FROM w) GROUP BY node")
def q_shortest_path(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.shortest_paths(calls, start).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"WITH RECURSIVE {C}, {START}, t AS (SELECT dst AS goal FROM calls JOIN s ON src = node ORDER BY dst DESC LIMIT 1), {_walk('src>dst', 5)} SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INT) AS length FROM w JOIN t ON node = goal")
def q_all_paths(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    goal = calls.join(start, F.col("src") == F.col("node")).agg(F.max("dst").alias("node"))
    return graph.all_paths(calls, start, goal, 5).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', 10)} SELECT node, depth, array_to_string(path, '>') AS path FROM w WHERE depth > 0")
def q_call_tree_forward(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.trace_calls(calls, start, 10).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {C}, {START}, {_walk('src>dst', 10)},
b AS (SELECT node, 0 AS depth, [node] AS path FROM s UNION ALL SELECT c.src, b.depth + 1, list_append(b.path, c.src) FROM b JOIN calls c ON c.dst = b.node WHERE b.depth < 10 AND NOT list_contains(b.path, c.src))
SELECT (SELECT node FROM s) AS start, (SELECT count(*) FROM w WHERE depth > 0) AS forward_calls, (SELECT count(*) FROM b WHERE depth > 0) AS backward_calls,
 (SELECT count(*) FROM calls JOIN s ON src = node AND dst = node) AS recursive_calls, (SELECT CAST(coalesce(max(depth), 0) AS INT) FROM w) AS max_depth,
 (SELECT count(*) FROM w WHERE depth > 0) + (SELECT count(*) FROM b WHERE depth > 0) AS total_calls""")
def q_call_chain_analysis(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.call_chain_analysis(calls, start, 10)


@query(f"""WITH RECURSIVE {C}, {START}, {_walk('src>dst', 6)}, m AS (SELECT node, min(path) AS path FROM w GROUP BY node)
SELECT node, CAST(len(path) - 1 AS INT) AS depth, CAST(row_number() OVER (ORDER BY path) AS INT) AS position FROM m""")
def q_dfs_order(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.dfs_order(calls, start, 6).drop("start")


VIEWS = f"""{C}, {R}, {E}, ids AS (SELECT element_id AS id, element_type FROM e),
d AS (SELECT from_element_id AS src, to_element_id AS dst, reference_type AS k, CASE reference_type WHEN 'TypeUsage' THEN 0.7 ELSE 0.3 END AS weight FROM refs
  WHERE reference_type IN ('TypeUsage', 'VariableAccess') AND from_element_id IN (SELECT id FROM ids) AND to_element_id IN (SELECT id FROM ids) GROUP BY ALL),
t AS (SELECT DISTINCT from_element_id AS src, to_element_id AS dst, 0.6 AS weight FROM refs WHERE reference_type = 'TypeUsage'
  AND from_element_id IN (SELECT id FROM ids WHERE element_type IN ('Struct', 'Enum', 'Trait')) AND to_element_id IN (SELECT id FROM ids WHERE element_type IN ('Struct', 'Enum', 'Trait')))"""


@query(f"""WITH {VIEWS},
v AS (SELECT 'CallChains' AS kind, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, 1.0 AS weight FROM calls
UNION ALL SELECT 'CallersChain', CAST(dst AS VARCHAR), CAST(src AS VARCHAR), 1.0 FROM calls UNION ALL SELECT 'Dependencies', src, dst, weight FROM d
UNION ALL SELECT 'Dependents', dst, src, weight FROM d UNION ALL SELECT 'TypeRelationships', src, dst, weight FROM t)
SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM v GROUP BY kind""")
def q_neighbours(spark, sf_dir):
    """The five edge views that traversals follow, summed up."""
    refs, elements = views.references(spark, sf_dir), views.elements(spark, sf_dir)
    calls = views.calls(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    tables = calls, graph.dependency_edges(refs, elements), graph.type_edges(refs, elements)
    out = None
    for kind in TRAVERSALS:
        rows = graph.neighbours(*tables, kind).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""WITH {VIEWS} SELECT (SELECT count(*) FROM e WHERE element_type = 'Function') AS functions, (SELECT count(*) FROM calls) AS call_chains, (SELECT count(*) FROM calls WHERE src = dst) AS recursive_calls,
 (SELECT max(call_count) FROM calls) AS most_calls, (SELECT count(*) FROM d) AS dependencies, (SELECT count(DISTINCT src) FROM d) AS dependent_elements, (SELECT count(*) FROM d) AS direct_dependencies,
 (SELECT count(*) FROM t) AS type_relationships, CAST(0 AS BIGINT) AS implementations, (SELECT count(DISTINCT src) FROM t) AS related_types""")
def q_graph_build_stats(spark, sf_dir):
    refs, elements = views.references(spark, sf_dir), views.elements(spark, sf_dir)
    return graph.build_stats(views.calls(spark, sf_dir), graph.dependency_edges(refs, elements), graph.type_edges(refs, elements), elements.where("element_type = 'Function'"))


@query(f"WITH RECURSIVE {C}, {START}, {_walk('src>dst', 40)} SELECT CAST(max(depth) AS INT) AS max_depth FROM w")
def q_max_depth(spark, sf_dir):
    calls, start = _stored_calls(spark, sf_dir)
    return graph.max_depth(calls, start)


@query(f"""WITH {R}, x AS (SELECT DISTINCT CAST(from_element_id AS BIGINT) AS src, CAST(to_element_id AS BIGINT) AS dst FROM refs)
SELECT CAST(src AS VARCHAR) AS cycle, 1 AS length, CAST(1 AS DOUBLE) AS strength FROM x WHERE src = dst
UNION ALL SELECT a.src || '>' || a.dst, 2, 0.5 FROM x a JOIN x b ON a.dst = b.src AND b.dst = a.src WHERE a.dst > a.src
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3, round(1 / 3, 9) FROM x a JOIN x b ON a.dst = b.src JOIN x c ON b.dst = c.src AND c.dst = a.src WHERE a.dst > a.src AND b.dst > a.src AND b.dst <> a.dst""")
def q_cycles(spark, sf_dir):
    edges = views.references(spark, sf_dir).select(F.col("from_element_id").cast("long").alias("src"), F.col("to_element_id").cast("long").alias("dst"))
    return graph.cycles(graph._checkpointed(edges.distinct()), 3).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "length", F.round("strength", 9).alias("strength"))


@query(f"""WITH RECURSIVE {R}, x AS (SELECT DISTINCT CAST(from_element_id AS BIGINT) AS src, CAST(to_element_id AS BIGINT) AS dst FROM refs),
c AS (SELECT * FROM x WHERE src IN (SELECT dst FROM x) AND dst IN (SELECT src FROM x)),
r AS (SELECT src AS a, dst AS b FROM c UNION SELECT r.a, c.dst FROM r JOIN c ON r.b = c.src)
SELECT p.a AS node, min(p.b) AS component, count(*) AS size FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a""")
def q_cyclic_components(spark, sf_dir):
    """All vertices on cycles, of whatever length; q_cycles lists those up to 3."""
    edges = views.references(spark, sf_dir).select(F.col("from_element_id").cast("long").alias("src"), F.col("to_element_id").cast("long").alias("dst"))
    return graph.cyclic_components(edges)


@query(f"WITH {C} SELECT src, count(*) AS n FROM calls GROUP BY src ORDER BY n DESC, src LIMIT 10")
def q_dependency_analysis(spark, sf_dir):
    return graph.dependency_analysis(views.calls(spark, sf_dir))


@query(f"""WITH RECURSIVE {E}, {R}, d AS (SELECT from_element_id AS src, to_element_id AS dst, reference_type FROM refs
 WHERE reference_type IN ('TypeUsage', 'VariableAccess') AND from_element_id IN (SELECT element_id FROM e) AND to_element_id IN (SELECT element_id FROM e) GROUP BY 1, 2, 3),
c AS (SELECT DISTINCT src, dst FROM d WHERE src IN (SELECT dst FROM d) AND dst IN (SELECT src FROM d)),
r AS (SELECT src AS a, dst AS b FROM c UNION SELECT r.a, c.dst FROM r JOIN c ON r.b = c.src),
g AS (SELECT p.a, min(p.b) AS component FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
SELECT count(*) AS total, count(*) AS direct, count(r.a) AS cyclic, avg(CAST(1 AS DOUBLE)) AS average_path_length, (SELECT count(DISTINCT component) FROM g) AS cyclic_components
FROM d LEFT JOIN r ON r.a = d.dst AND r.b = d.src""")
def q_dependency_totals(spark, sf_dir):
    return graph.dependency_totals(graph.dependency_edges(views.references(spark, sf_dir), views.elements(spark, sf_dir)))


@query(f"WITH {C} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS neighbors FROM calls GROUP BY src")
def q_adjacency(spark, sf_dir):
    return graph.adjacency(views.calls(spark, sf_dir)).withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term IN ('the', 'that', 'with') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id AS id, round(sum((1 + ln(tf)) * ln(1 + n / df)), 6) AS rank FROM p JOIN f USING (term), n GROUP BY doc_id HAVING count(*) = 3""")
def q_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.search(search.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")), "The that, with").withColumn("rank", F.round("rank", 6))


CHUNK = "CASE WHEN len(doc_comments) > 0 THEN array_to_string(doc_comments, chr(10)) || chr(10) || chr(10) ELSE '' END || coalesce(signature, name)"


@query(f"""WITH {E}, k AS (SELECT *, {CHUNK} AS content FROM e WHERE visibility = 'Public' AND NOT contains(lower(name), 'test') AND len(list_filter(attributes, lambda a: contains(a, 'test'))) = 0)
SELECT 'chunk_' || relative_path || '_' || element_id AS id, content, 'File: ' || relative_path || chr(10) || 'Module: ' || module_path || chr(10) || chr(10) || content || chr(10) || 'Complexity: ' || complexity AS content_with_context,
 CAST(ceil(strlen(content) / 4) AS BIGINT) AS token_count, CASE element_type WHEN 'Function' THEN 'behavior' WHEN 'Struct' THEN 'data_structure' WHEN 'Enum' THEN 'data_structure' WHEN 'Trait' THEN 'interface' WHEN 'Impl' THEN 'implementation' ELSE 'organization' END AS semantic_category,
 CASE WHEN len(doc_comments) = 0 THEN 'CodeOnly' WHEN signature IS NULL THEN 'DocumentationOnly' ELSE 'Combined' END AS embedding_strategy, md5(content) AS semantic_hash,
 CASE WHEN len(doc_comments) = 0 THEN 'Missing' WHEN contains(lower(array_to_string(doc_comments, ' ')), 'example') AND strlen(array_to_string(doc_comments, ' ')) > 100 AND (parameter_count = 0 OR regexp_matches(lower(array_to_string(doc_comments, ' ')), 'param|argument')) THEN 'Excellent'
  WHEN strlen(array_to_string(doc_comments, ' ')) > 100 AND (contains(lower(array_to_string(doc_comments, ' ')), 'example') OR parameter_count = 0 OR regexp_matches(lower(array_to_string(doc_comments, ' ')), 'param|argument')) THEN 'Good' ELSE 'Basic' END AS documentation_quality,
 array_to_string(list_filter([CASE WHEN regexp_matches(lower(name), 'http|web|request') THEN 'web' END, CASE WHEN regexp_matches(lower(name), 'db|sql|query') THEN 'database' END, CASE WHEN regexp_matches(lower(name), 'async|future') THEN 'async' END, CASE WHEN regexp_matches(lower(name), 'test|mock') THEN 'testing' END], lambda x: x IS NOT NULL), ',') AS domain_tags,
 array_to_string(list_filter([CASE WHEN regexp_matches(lower(name), '^(new|create|build)') THEN 'constructor' END, CASE WHEN starts_with(lower(name), 'get') THEN 'getter' END, CASE WHEN starts_with(lower(name), 'set') THEN 'setter' END, CASE WHEN regexp_matches(lower(name), '^(is|has)') THEN 'predicate' END,
  CASE WHEN element_type = 'Trait' THEN 'contract' END, CASE WHEN element_type IN ('Struct', 'Enum') THEN 'model' END], lambda x: x IS NOT NULL), ',') AS intent_tags FROM k""")
def q_rag_chunks(spark, sf_dir):
    df = rag.chunks(views.elements(spark, sf_dir)).drop("retrieval_keywords")
    return df.withColumns({c: F.array_join(c, ",") for c in ("domain_tags", "intent_tags")})


@query("SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_semantic_dedup(spark, sf_dir):
    return rag.duplicates(table(spark, sf_dir, "documents").select(text.semantic_hash("text").alias("hash")), "hash")


@query(rf"""WITH {E}, k AS (SELECT element_id, list_concat([lower(name), lower(qualified_name)], list_filter(list_transform(list_filter(string_split_regex(array_to_string(doc_comments, ' '), '\s+'), lambda w: strlen(w) > 3),
 lambda w: regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')) AS k FROM e)
SELECT element_id, array_to_string(list_sort(list_distinct(k))[1:20], ' ') AS keywords FROM k""")
def q_keywords(spark, sf_dir):
    return views.elements(spark, sf_dir).select("element_id", F.array_join(text.keywords(F.col("name"), F.col("qualified_name"), F.col("doc_comments")), " ").alias("keywords"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({WORDS.format('text')}) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 9) AS similarity FROM b a JOIN b ON a.item_id < b.item_id""")
def q_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.words("text")).alias("w"))
    x, y = b.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), b.select(F.col("item_id").alias("b"), F.col("w").alias("wb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(text.jaccard(F.col("wa"), F.col("wb")), 9).alias("similarity"))


@query("""WITH n AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part), c AS (SELECT p_partkey, w, w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || x[2:]), '') AS camel FROM n)
SELECT p_partkey, camel, array_to_string(w, '_') AS snake FROM c""")
def q_case_conversion(spark, sf_dir):
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    df = table(spark, sf_dir, "part").select("p_partkey", text.snake_to_camel(snake).alias("camel"))
    return df.select("p_partkey", "camel", text.camel_to_snake("camel").alias("snake"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ',' || p_type ELSE '' END AS constraints FROM part")
def q_generic_constraints(spark, sf_dir):
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Vec< "), "p_brand", F.lit(" ,"), "p_type", F.lit(", >"))).otherwise("plain")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.generic_constraints(t), ",").alias("constraints"))


@query(f"""WITH {E}, x AS (SELECT * FROM e WHERE len(doc_comments) > 0)
SELECT element_id, 'What does ' || name || ' do?' AS question, array_to_string(doc_comments, ' ') AS answer FROM x
UNION ALL SELECT element_id, 'How do I use ' || name || '?', CASE WHEN element_type = 'Function' THEN 'let result = ' || name || '();' WHEN element_type IN ('Struct', 'Enum') THEN 'let value: ' || name || ' = todo!();' ELSE 'use crate::' || name || ';' END FROM x WHERE visibility = 'Public'
UNION ALL SELECT element_id, 'How many parameters does ' || name || ' take?', CAST(parameter_count AS VARCHAR) FROM x WHERE element_type = 'Function' AND parameter_count > 0""")
def q_qa_pairs(spark, sf_dir):
    return rag.qa_pairs(views.elements(spark, sf_dir))


@query(f"""WITH {E} SELECT element_id, 'Write a ' || lower(element_type) || ' named ' || name AS prompt, {CHUNK} AS completion,
 CASE WHEN complexity <= 2 AND len(generic_params) = 0 THEN 'beginner' WHEN complexity <= 5 AND len(doc_comments) > 0 THEN 'intermediate' WHEN complexity > 10 OR len(generic_params) > 0 THEN 'advanced' ELSE 'intermediate' END AS difficulty,
 array_to_string(list_concat(list_filter([lower(element_type), lower(visibility), CASE WHEN len(generic_params) > 0 THEN 'generic' END, CASE WHEN len(doc_comments) > 0 THEN 'documented' END, CASE WHEN complexity > 5 THEN 'complex' END], lambda x: x IS NOT NULL), attributes), ',') AS tags
FROM e WHERE element_type IN ('Function', 'Struct', 'Enum', 'Trait') AND (visibility = 'Public' OR len(doc_comments) > 0)""")
def q_training_examples(spark, sf_dir):
    return rag.training_examples(views.elements(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total, count(*) AS n FROM events GROUP BY 1")
def q_json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_total"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_pending(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH {E}, k AS (SELECT CASE WHEN element_type = 'Function' THEN 'functions' WHEN element_type IN ('Struct', 'Enum') THEN 'types' WHEN element_type = 'Trait' THEN 'traits' WHEN element_type = 'Module' THEN 'modules' END AS surface, name FROM e WHERE visibility = 'Public')
SELECT surface, count(*) AS n, array_to_string(list_sort(list(name)), ',') AS names FROM k WHERE surface IS NOT NULL GROUP BY surface""")
def q_api_surface(spark, sf_dir):
    return metrics.api_surface(views.elements(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query(f"""WITH {E} SELECT relative_path, round(avg(complexity), 9) AS avg_complexity, round(CASE WHEN count(*) FILTER (WHERE visibility = 'Public') = 0 THEN 1 ELSE count(*) FILTER (WHERE visibility = 'Public' AND len(doc_comments) > 0) / count(*) FILTER (WHERE visibility = 'Public') END, 9) AS doc_ratio,
 coalesce(array_to_string(list_transform(list_sort(list((-complexity, 'complex: ' || name)) FILTER (WHERE complexity > 15))[1:3], lambda x: x[2]), ';'), '') AS issues FROM e GROUP BY relative_path""")
def q_file_report(spark, sf_dir):
    df = metrics.file_report(views.elements(spark, sf_dir))
    return df.select("relative_path", F.round("avg_complexity", 9).alias("avg_complexity"), F.round("doc_ratio", 9).alias("doc_ratio"), F.array_join("issues", ";").alias("issues"))


@query(f"WITH {E} SELECT complexity, count(*) AS n FROM e GROUP BY complexity")
def q_complexity_histogram(spark, sf_dir):
    return metrics.histogram(views.elements(spark, sf_dir), "complexity")


@query(f"WITH {E} SELECT element_type, count(*) AS n, count(*) FILTER (WHERE visibility = 'Public') AS public, round(avg(complexity) FILTER (WHERE element_type = 'Function'), 9) AS avg_complexity FROM e GROUP BY element_type")
def q_llm_summaries(spark, sf_dir):
    return rag.summaries(views.elements(spark, sf_dir)).withColumn("avg_complexity", F.round("avg_complexity", 9))


@query(f"""WITH {E} SELECT element_id, '### ' || name || chr(10) || chr(10) || '**Type:** ' || element_type || ' | **Visibility:** ' || visibility || chr(10)
 || CASE WHEN len(doc_comments) > 0 THEN chr(10) || array_to_string(doc_comments, chr(10)) || chr(10) ELSE '' END
 || coalesce(chr(10) || '```rust' || chr(10) || signature || chr(10) || '```' || chr(10), '') AS markdown FROM e""")
def q_markdown(spark, sf_dir):
    from ..sources import sinks

    return views.elements(spark, sf_dir).select("element_id", sinks.markdown_block().alias("markdown"))


from . import reports  # noqa: E402, F401 (registers its queries)

"""More queries over the driver's tables: names, documentation, retrieval, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import elements as el
from ..operators import metrics, namespaces, rag, search
from . import views
from .catalog import CHUNK, FILES, SHOWN, query
from .views import E, R, table

SCOPE = "CASE WHEN visibility = 'Restricted' THEN CASE WHEN key % 2 = 0 THEN 'crate' ELSE {} END END"


def _joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


@query(f"""WITH {E} SELECT element_id, name AS simple_name, qualified_name AS canonical_path, visibility = 'Public' AS is_public,
 CASE WHEN visibility = 'Public' THEN 'Public' WHEN visibility = 'Private' THEN 'Private' WHEN key % 2 = 0 THEN 'Crate' ELSE module_path END AS scope,
 visibility <> 'Private' AND NOT (visibility = 'Restricted' AND key % 2 = 1 AND NOT starts_with('Brand#1', module_path)) AS reachable FROM e""")
def q_namespaces(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumn("visibility_scope", F.expr(SCOPE.format("'in ' || module_path")))
    rows = namespaces.namespaces(e)
    return rows.withColumn("reachable", namespaces.accessible_from(F.col("scope"), F.col("canonical_path"), F.lit("Brand#1")))


def _imports(spark, sf_dir, item):
    e = views.elements(spark, sf_dir).where("key % 4 = 2")
    return e.select("relative_path", "module_path", F.array(item).alias("imported_items"), F.lit(False).alias("is_glob"), F.concat(F.lit("a"), "element_id").alias("alias"))


@query(f"""WITH {E} SELECT element_id, CASE key % 4 WHEN 0 THEN name WHEN 1 THEN 'ext::' || name WHEN 2 THEN 'a' || key ELSE 'other' || key END AS reference_text,
 CASE key % 4 WHEN 0 THEN qualified_name WHEN 1 THEN 'ext::' || name WHEN 2 THEN module_path || '::imp_' || key ELSE module_path || '::other' || key END AS canonical_path FROM e""")
def q_resolved_names(spark, sf_dir):
    e = views.elements(spark, sf_dir)
    names = namespaces.import_names(_imports(spark, sf_dir, F.concat(F.lit("imp_"), "element_id")))
    said = F.expr("CASE key % 4 WHEN 0 THEN name WHEN 1 THEN 'ext::' || name WHEN 2 THEN 'a' || element_id ELSE 'other' || element_id END")
    refs = e.select("element_id", "relative_path", said.alias("reference_text"), F.col("module_path").alias("scope"))
    return namespaces.resolve(refs, names, e).select("element_id", "reference_text", "canonical_path")


@query(f"""WITH {E}, n AS (SELECT qualified_name AS canonical_path, name AS local FROM e UNION ALL SELECT module_path || '::' || name, 'a' || key FROM e WHERE key % 4 = 2)
SELECT canonical_path, array_to_string(list_sort(list(DISTINCT local)), ',') AS aliases FROM n GROUP BY canonical_path""")
def q_aliases(spark, sf_dir):
    names = namespaces.import_names(_imports(spark, sf_dir, F.col("name")))
    return namespaces.aliases(views.elements(spark, sf_dir), names).select("canonical_path", _joined("aliases"))


SCORED = f"""{E}, x AS (SELECT *, element_type = 'Function' AS fn, len(doc_comments) AS k, array_to_string(doc_comments, ' ') AS t FROM e),
y AS (SELECT *, strlen(t) AS n, lower(t) AS w FROM x),
q AS (SELECT *, CASE WHEN k = 0 THEN 0.0 WHEN fn THEN (CAST(n > 20 AS INT) + CAST(contains(w, 'return') AS INT) + CAST(contains(w, 'param') OR parameter_count = 0 AS INT) + CAST(contains(w, 'example') AS INT)
 + CAST(contains(t, '`') OR contains(t, '#') AS INT)) / 5 ELSE (CAST(n > 20 AS INT) + CAST(n > 50 AS INT) + CAST(contains(t, '`') OR contains(t, '#') AS INT)) / 3 END AS quality FROM y)"""


@query(f"""WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (WHERE k > 0) AS documented, round(coalesce(avg(quality) FILTER (WHERE k > 0), 0), 9) AS average_quality,
 round(count(*) FILTER (WHERE k > 0) / count(*), 9) AS coverage FROM q""")
def q_documentation_coverage(spark, sf_dir):
    return metrics.documentation_coverage(views.elements(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("average_quality", "coverage")})


@query(f"""WITH {SCORED} SELECT element_id, name, round(quality, 9) AS quality, array_to_string(list_filter([CASE WHEN n < 20 THEN 'say more' END,
 CASE WHEN fn AND NOT contains(w, 'return') AND coalesce(signature, '') <> '' AND NOT contains(signature, '()') THEN 'say what is returned' END,
 CASE WHEN fn AND contains(coalesce(signature, ''), '(') AND NOT contains(w, 'param') AND NOT contains(t, '# Arguments') THEN 'name the parameters' END,
 CASE WHEN fn AND NOT contains(t, '```') AND NOT contains(t, '# Example') THEN 'give an example' END, CASE WHEN quality < 0.3 THEN 'write it anew' END], lambda v: v IS NOT NULL), ',') AS suggestions
FROM q WHERE k > 0 AND quality < 0.7""")
def q_documentation_enhancements(spark, sf_dir):
    return metrics.enhancements(views.elements(spark, sf_dir)).select("element_id", "name", F.round("quality", 9).alias("quality"), _joined("suggestions"))


@query(f"""WITH {E}, t AS (SELECT name AS target, arg_max(element_id, (ordinal, element_id)) AS target_id, arg_max(element_type, (ordinal, element_id)) AS target_type, arg_max(line_start, (ordinal, element_id)) AS target_line FROM e GROUP BY name)
SELECT e.element_id, target, target_id, target_type, target_line FROM e JOIN t ON t.target = e.name WHERE e.complexity % 5 = 0""")
def q_documentation_links(spark, sf_dir):
    named = F.when(F.col("complexity") % 5 == 0, F.array("name", F.concat(F.lit("no "), "name"))).otherwise(F.array().cast("array<string>"))
    return metrics.documentation_links(views.elements(spark, sf_dir).withColumn("dependencies", named))


@query(f"""WITH {E} SELECT element_id, name, CASE WHEN element_type = 'Function' THEN 'let result = ' || name || '();' WHEN element_type IN ('Struct', 'Enum') THEN 'let value: ' || name || ' = todo!();' ELSE 'use crate::' || name || ';' END AS example
FROM e WHERE visibility = 'Public'""")
def q_documentation_examples(spark, sf_dir):
    return metrics.documentation_examples(views.elements(spark, sf_dir))


@query(f"WITH {E}, {FILES} SELECT *, replace(relative_path, 'src/', '') AS file_name, 'rs' AS extension, round(complexity_total / greatest(function_count, 1), 9) AS complexity_average FROM f")
def q_file_records(spark, sf_dir):
    return metrics.file_records(views.elements(spark, sf_dir)).withColumn("complexity_average", F.round("complexity_average", 9))


@query(f"""WITH {E}, {FILES} SELECT 'p' AS name, '1.0.0' AS version, count(*) AS total_files, CAST(sum(element_count) AS BIGINT) AS total_elements, CAST(sum(function_count) AS BIGINT) AS total_function_count,
 CAST(max(complexity_total) AS BIGINT) AS complexity_max, round(sum(complexity_total) / sum(element_count), 9) AS complexity_avg, CAST(NULL AS VARCHAR) AS license FROM f""")
def q_project_record(spark, sf_dir):
    df = metrics.project_record(views.elements(spark, sf_dir), "p", "1.0.0").withColumn("complexity_avg", F.round("complexity_avg", 9))
    return df.select("name", "version", "total_files", "total_elements", "total_function_count", F.col("complexity_max").cast("long").alias("complexity_max"), "complexity_avg", "license")


@query(f"""WITH {E}, {R} SELECT 'module' AS dimension, module_path AS bucket, count(*) AS n FROM e GROUP BY module_path UNION ALL SELECT 'reference', reference_type, count(*) FROM refs GROUP BY reference_type""")
def q_module_report(spark, sf_dir):
    return metrics.module_report(views.elements(spark, sf_dir), views.references(spark, sf_dir))


PARENT = "CASE WHEN key % 10 <> 0 THEN CAST(key - key % 10 AS {}) END"


@query(f"""WITH {E}, {R}, p AS (SELECT *, {PARENT.format('VARCHAR')} AS parent_id FROM e), c AS (SELECT relative_path AS rp, parent_id AS pid, list_sort(list(DISTINCT element_id)) AS l FROM p WHERE parent_id IS NOT NULL GROUP BY ALL),
o AS (SELECT from_element_id AS id, list_sort(list(DISTINCT to_element_id)) AS l FROM refs GROUP BY 1), i AS (SELECT to_element_id AS id, list_sort(list(DISTINCT from_element_id)) AS l FROM refs GROUP BY 1)
SELECT 'chunk_' || p.relative_path || '_' || element_id AS id, p.relative_path AS file_path, line_start AS start_line, line_end AS end_line, name AS element_name, CAST(ceil(strlen({CHUNK}) / 4) AS BIGINT) AS token_count,
 len(doc_comments) > 0 AS has_documentation, coalesce(parent_id, '') AS parent_elements, coalesce(array_to_string(c.l, ','), '') AS child_elements, coalesce(array_to_string(o.l, ','), '') AS "references", coalesce(array_to_string(i.l, ','), '') AS referenced_by
FROM p LEFT JOIN c ON c.rp = p.relative_path AND c.pid = p.element_id LEFT JOIN o ON o.id = p.element_id LEFT JOIN i ON i.id = p.element_id
WHERE visibility = 'Public' AND NOT contains(lower(name), 'test') AND len(list_filter(attributes, lambda a: contains(a, 'test'))) = 0""")
def q_chunk_metadata(spark, sf_dir):
    e = views.elements(spark, sf_dir).withColumn("parent_id", F.expr(PARENT.format("STRING")))
    df = rag.chunk_metadata(e, views.references(spark, sf_dir))
    lists = ("parent_elements", "child_elements", "references", "referenced_by")
    return df.select("id", "file_path", "start_line", "end_line", "element_name", "token_count", "has_documentation", *map(_joined, lists))


@query(f"""WITH {E}, t AS (SELECT CAST(ceil(strlen({CHUNK}) / 4) AS BIGINT) AS t FROM e), s AS (SELECT count(*) AS n, list_sort(list(t)) AS s, CAST(sum(t) AS BIGINT) AS total, min(t) AS a, max(t) AS b, avg(t) AS m FROM t)
SELECT n AS total_chunks, total AS tokens_total, a AS tokens_min, b AS tokens_max, round(m, 6) AS tokens_avg, s[CAST(floor(n / 2) AS INT) + 1] AS tokens_median, s[CAST(least(floor(n * .95), n - 1) AS INT) + 1] AS tokens_p95,
 (SELECT count(*) FROM e WHERE element_type = 'Function') AS functions, (SELECT count(*) FROM e WHERE complexity <= 2) AS simple, 'p' AS name FROM s""")
def q_document_metadata(spark, sf_dir):
    row = rag.document_metadata(views.elements(spark, sf_dir), {"name": "p"})
    counts = {"functions": F.element_at("element_distribution", "Function"), "simple": F.coalesce(F.try_element_at("complexity_distribution", F.lit("Simple")), F.lit(0).cast("long")), "tokens_avg": F.round("tokens_avg", 6)}
    return row.withColumns(counts).select("total_chunks", "tokens_total", "tokens_min", "tokens_max", "tokens_avg", "tokens_median", "tokens_p95", "functions", "simple", "name")


@query(f"""WITH {E}, k AS (SELECT *, CASE WHEN signature IS NULL THEN name ELSE {CHUNK} END AS content FROM e)
SELECT element_id, content, 'File: ' || relative_path || ', Module: ' || module_path || ', Element: ' || name || ' (' || element_type || ')' AS context,
 CASE element_type WHEN 'Function' THEN 'function_definition' WHEN 'Struct' THEN 'data_structure' WHEN 'Enum' THEN 'data_structure' WHEN 'Trait' THEN 'interface_definition' WHEN 'Module' THEN 'module_organization' ELSE 'other' END AS semantic_category,
 'Rust ' || lower(element_type) || ' ' || name || ', complexity ' || coalesce(complexity, 0) || ', module ' || module_path AS embedding_hint, CAST(ceil(strlen(content) / 4) AS BIGINT) AS token_count FROM k""")
def q_code_chunks(spark, sf_dir):
    return rag.code_chunks(views.elements(spark, sf_dir))


DIFFICULTY = "CASE WHEN complexity <= 2 AND len(generic_params) = 0 THEN 'beginner' WHEN complexity <= 5 AND len(doc_comments) > 0 THEN 'intermediate' WHEN complexity > 10 OR len(generic_params) > 0 THEN 'advanced' ELSE 'intermediate' END"


@query(f"""WITH {E} SELECT 'type' AS dimension, element_type AS bucket, count(*) AS n FROM e GROUP BY element_type
UNION ALL SELECT 'complexity', CASE WHEN complexity <= 2 THEN 'Simple' WHEN complexity <= 5 THEN 'Moderate' WHEN complexity <= 10 THEN 'Complex' ELSE 'Very Complex' END AS b, count(*) FROM e WHERE complexity IS NOT NULL GROUP BY b
UNION ALL SELECT 'difficulty', {DIFFICULTY} AS d, count(*) FROM e WHERE element_type IN ('Function', 'Struct', 'Enum', 'Trait') AND (visibility = 'Public' OR len(doc_comments) > 0) GROUP BY d""")
def q_dataset_metadata(spark, sf_dir):
    return rag.dataset_metadata(views.elements(spark, sf_dir))


@query(f"""WITH {E}, k AS (SELECT CASE WHEN len(doc_comments) = 0 THEN 'CodeOnly' WHEN signature IS NULL THEN 'DocumentationOnly' ELSE 'Combined' END AS embedding_strategy, CAST(ceil(strlen({CHUNK}) / 4) AS BIGINT) AS t FROM e
 WHERE visibility = 'Public' AND NOT contains(lower(name), 'test') AND len(list_filter(attributes, lambda a: contains(a, 'test'))) = 0)
SELECT embedding_strategy, count(*) AS chunks, round(avg(t), 6) AS tokens_avg, min(t) AS tokens_min, max(t) AS tokens_max FROM k GROUP BY 1""")
def q_chunk_sizes(spark, sf_dir):
    return rag.chunk_sizes(rag.chunks(views.elements(spark, sf_dir))).withColumn("tokens_avg", F.round("tokens_avg", 6))


PACKED = """d AS (SELECT source, CAST(coalesce(ceil(strlen(text) / 4), 0) AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, ceil(strlen(text) / 4)) AS i FROM documents),
w AS (SELECT source, i, 0 AS chunk, CAST(1 AS BIGINT) AS k, t AS total FROM d WHERE i = 1 UNION ALL
 SELECT d.source, d.i, CASE WHEN w.total + d.t > 4000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.total + d.t > 4000 THEN 1 ELSE w.k + 1 END, CASE WHEN w.total + d.t > 4000 THEN d.t ELSE w.total + d.t END
 FROM w JOIN d ON d.source IS NOT DISTINCT FROM w.source AND d.i = w.i + 1),
p AS (SELECT source, chunk, max(k) AS items, arg_max(total, i) AS tokens FROM w GROUP BY source, chunk)"""


@query(f"WITH RECURSIVE {PACKED} SELECT * FROM p")
def q_llm_packing(spark, sf_dir):
    return rag.pack(table(spark, sf_dir, "documents"), text.token_estimate("text"), 4000, "source", "doc_id")


@query(f"WITH RECURSIVE {PACKED} SELECT count(*) AS chunks, round(avg(items), 6) AS average_items, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / (count(*) * 4000), 9) AS token_efficiency FROM p")
def q_llm_chunk_stats(spark, sf_dir):
    df = rag.chunk_stats(q_llm_packing(spark, sf_dir), 4000)
    return df.withColumns({"average_items": F.round("average_items", 6), "token_efficiency": F.round("token_efficiency", 9)})


STEM = "regexp_replace(w, '^(.{3,}?)(ing|ed|ly|ies|y|s)$', '\\1')"


@query(rf"""WITH {E}, f AS (SELECT element_id, name, unnest([(1.0, name), (0.4, qualified_name), (0.2, signature), (0.1, array_to_string(doc_comments, ' '))]) AS f FROM e),
w AS (SELECT element_id, name, f[1] AS wt, unnest(list_filter(string_split_regex(lower(replace(f[2], '_', ' ')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM f),
p AS (SELECT element_id, name, wt, {STEM} AS term, count(*) AS n FROM w WHERE w NOT IN {search.STOP_WORDS} GROUP BY ALL),
i AS (SELECT term, element_id, name, sum(CAST(wt AS DOUBLE) * (1 + ln(n))) AS weight FROM p GROUP BY ALL)
SELECT element_id, name, round(sum(weight), 6) AS rank FROM i WHERE term IN ('red', 'example') GROUP BY element_id, name HAVING count(*) = 2""")
def q_ranked_search(spark, sf_dir):
    """Elements about a word, by stemmed and weighted terms."""
    index = search.weighted_postings(views.elements(spark, sf_dir))
    return search.ranked(index, "The Reds, examples").withColumn("rank", F.round("rank", 6))


@query(f"WITH {E} SELECT {SHOWN} FROM e ORDER BY complexity DESC, element_id LIMIT 5")
def q_top_complex(spark, sf_dir):
    return el.ElementQuery(views.elements(spark, sf_dir)).order_by("complexity", True).order_by("element_id").limit(5).run().select(*SHOWN.split(", "))

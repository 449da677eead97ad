"""Stand-ins for code tables over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ELEMENTS = """
  SELECT 'p' AS project_id, 'src/' || lower(p_brand) || '.rs' AS relative_path, CAST(p_partkey AS VARCHAR(20)) AS element_id,
    CASE p_type WHEN 'STANDARD' THEN 'Function' WHEN 'MEDIUM' THEN 'Struct' WHEN 'SMALL' THEN 'Enum'
      WHEN 'ECONOMY' THEN 'Trait' WHEN 'LARGE' THEN 'Impl' ELSE 'Module' END AS element_type,
    replace(p_name, ' ', '_') AS name, p_brand || '::' || replace(p_name, ' ', '_') AS qualified_name, p_brand AS module_path,
    CASE WHEN p_type = 'STANDARD' THEN CASE WHEN p_size % 8 = 0 THEN 'async ' WHEN p_size % 9 = 0 THEN 'unsafe ' ELSE '' END || 'fn ' || replace(p_name, ' ', '_') || '()' END AS signature,
    CASE p_partkey % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Restricted' ELSE 'Private' END AS visibility,
    p_size AS complexity, CAST(floor((p_size + 1) / 2) AS INT) AS cyclomatic, p_size AS cognitive, p_size % 7 AS nesting_depth,
    p_size % 9 AS parameter_count, p_size % 3 AS return_count, p_size * 3 AS lines_of_code,
    CAST(p_partkey AS INT) AS line_start, CAST(p_partkey AS INT) + p_size * 3 AS line_end, CAST(p_partkey AS INT) AS ordinal, {arrays}, p_partkey AS key
  FROM part"""

SPARK_ARRAYS = """
    CASE WHEN p_size % 4 = 0 THEN CAST(array() AS array<string>) ELSE array('A ' || p_name || ' that helps.', 'Example: `' || replace(p_name, ' ', '_') || '`') END AS doc_comments,
    CASE WHEN p_size % 10 = 0 THEN array('#[test]') WHEN p_size % 7 = 0 THEN array('#[deprecated]') ELSE CAST(array() AS array<string>) END AS attributes,
    CASE WHEN p_size % 5 = 0 THEN array(p_brand) ELSE CAST(array() AS array<string>) END AS dependencies,
    CASE WHEN p_size % 6 = 0 THEN array('T') ELSE CAST(array() AS array<string>) END AS generic_params"""
DUCK_ARRAYS = """
    CASE WHEN p_size % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['A ' || p_name || ' that helps.', 'Example: `' || replace(p_name, ' ', '_') || '`'] END AS doc_comments,
    CASE WHEN p_size % 10 = 0 THEN ['#[test]'] WHEN p_size % 7 = 0 THEN ['#[deprecated]'] ELSE CAST([] AS VARCHAR[]) END AS attributes,
    CASE WHEN p_size % 5 = 0 THEN [p_brand] ELSE CAST([] AS VARCHAR[]) END AS dependencies,
    CASE WHEN p_size % 6 = 0 THEN ['T'] ELSE CAST([] AS VARCHAR[]) END AS generic_params"""

CALLS = """
  SELECT src, dst, count(*) AS call_count FROM (SELECT min(l_partkey) AS src, max(l_partkey) AS dst FROM lineitem GROUP BY l_orderkey) o
  WHERE src <> dst GROUP BY src, dst"""
REFS = """
  SELECT CAST(l_partkey AS VARCHAR(20)) AS from_element_id, CAST(l_suppkey AS VARCHAR(20)) AS to_element_id,
    CASE l_returnflag WHEN 'A' THEN 'FunctionCall' WHEN 'R' THEN 'TypeUsage' ELSE 'VariableAccess' END AS reference_type,
    CASE l_linestatus WHEN 'F' THEN 'm::f' ELSE 'x.f' END AS reference_text, l_linenumber AS line, true AS is_resolved
  FROM lineitem"""
TREE = """
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR(20)) AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer"""

E = f"e AS ({ELEMENTS.format(arrays=DUCK_ARRAYS)})"
C = f"calls AS ({CALLS})"
R = f"refs AS ({REFS})"
T = f"tree AS ({TREE})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    for n in names:
        query = query.replace(f"FROM {n}", f"FROM parquet.`{sf_dir}/{n}.parquet`")
    return spark.sql(query.replace("VARCHAR(20)", "STRING"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ELEMENTS.format(arrays=SPARK_ARRAYS), "part")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CALLS, "lineitem")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REFS, "lineitem")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TREE, "region", "nation", "customer")

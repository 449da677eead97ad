"""Names across modules: namespaces, aliases, resolution, accessibility.

A canonical path is an element's qualified name. Imports are rows with a local
name (``alias``, or the item) and the path that it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope_kind(visibility: Column, scope: Column) -> Column:
    """Public, Crate, Super, Private, or the module that an element is visible in."""
    inside = F.when(scope.contains("crate"), "Crate").when(scope.contains("super"), "Super").otherwise(F.trim(F.regexp_replace(scope, r"^in\s+", "")))
    return F.when(visibility == "Public", "Public").when(visibility == "Restricted", F.coalesce(inside, F.lit("Crate"))).otherwise("Private")


def namespaces(elements: DataFrame) -> DataFrame:
    """(element_id, simple_name, canonical_path, is_public, scope) of every element."""
    public = (F.col("visibility") == "Public") | F.coalesce((F.col("visibility") == "Restricted") & F.col("visibility_scope").contains("pub"), F.lit(False))
    return elements.select("element_id", F.col("name").alias("simple_name"), F.col("qualified_name").alias("canonical_path"), public.alias("is_public"), scope_kind(F.col("visibility"), F.col("visibility_scope")).alias("scope"))


def import_names(imports: DataFrame) -> DataFrame:
    """(relative_path, local, path): a row for each name that an import brings in.

    Glob imports name nothing and give no row.
    """
    item = F.explode_outer("imported_items").alias("item")
    rows = imports.where(~F.col("is_glob")).select("relative_path", "module_path", "alias", item)
    path = F.when(F.col("item").isNull(), F.col("module_path")).otherwise(F.concat_ws("::", "module_path", "item"))
    local = F.coalesce(F.col("alias"), F.col("item"), F.element_at(F.split("module_path", "::"), -1))
    return rows.select("relative_path", local.alias("local"), path.alias("path")).distinct()


def aliases(elements: DataFrame, names: DataFrame) -> DataFrame:
    """(canonical_path, aliases): local names that imports give a path, with its own."""
    own = elements.select(F.col("qualified_name").alias("canonical_path"), F.col("name").alias("local"))
    given = names.select(F.col("path").alias("canonical_path"), "local").join(own.select("canonical_path").distinct(), "canonical_path", "left_semi")
    return own.unionByName(given).groupBy("canonical_path").agg(F.sort_array(F.collect_set("local")).alias("aliases"))


def reference_names(elements: DataFrame, names: DataFrame) -> DataFrame:
    """(element_id, reference_name): everything that an element can be called by."""
    known = aliases(elements, names).select(F.col("canonical_path").alias("_path"), F.explode("aliases").alias("reference_name"))
    every = elements.join(known, F.col("qualified_name") == F.col("_path")).select("element_id", "reference_name")
    return every.unionByName(elements.select("element_id", F.col("qualified_name").alias("reference_name"))).distinct()


def resolve(references: DataFrame, names: DataFrame, elements: DataFrame) -> DataFrame:
    """``references`` with ``canonical_path``, within each file.

    First the file's imports count, then its own elements (the first of a name),
    then a path is taken as it is; any other name is one of the current module
    (``scope``).
    """
    imported = names.groupBy(F.col("relative_path").alias("_f1"), F.col("local").alias("_n1")).agg(F.min("path").alias("_a"))
    own = elements.groupBy(F.col("relative_path").alias("_f2"), F.col("name").alias("_n2")).agg(F.min_by("qualified_name", "ordinal").alias("_b"))
    text = F.col("reference_text")
    df = references.join(imported, (F.col("relative_path") == F.col("_f1")) & (text == F.col("_n1")), "left").join(own, (F.col("relative_path") == F.col("_f2")) & (text == F.col("_n2")), "left")
    path = F.coalesce("_a", "_b", F.when(text.contains("::"), text), F.concat_ws("::", "scope", "reference_text"))
    return df.withColumn("canonical_path", path).drop("_f1", "_n1", "_a", "_f2", "_n2", "_b")


def accessible_from(scope: Column, canonical_path: Column, place: Column) -> Column:
    """Whether an element of that scope (see ``scope_kind``) can be used at ``place``."""
    return F.when(scope.isin("Public", "Crate"), True).when(scope == "Super", place.startswith(canonical_path)).when(scope == "Private", place == canonical_path).otherwise(place.startswith(scope))


def path_accessible(path: Column, place: Column) -> Column:
    """Whether a path and a place lie in one line of modules, or the path is public."""
    return path.startswith("pub ") | path.startswith("crate::") | place.startswith(path) | path.startswith(place)


def references_of(references: DataFrame, element_id: str, incoming: bool = False) -> DataFrame:
    return references.where(F.col("to_element_id" if incoming else "from_element_id") == element_id)

"""A lazy query over elements: filters, relationships, order and limit."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

SORTABLE = frozenset({"name", "qualified_name", "complexity", "line_start", "element_type", "visibility", "lines_of_code", "element_id", "created_at"})


@dataclass(frozen=True)
class ElementQuery:
    """Conditions that are joined by AND; ``run`` builds the plan.

    Every method returns a new query. Nothing is put into SQL text, and only
    known columns can be ordered by.
    """

    elements: DataFrame
    conditions: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    most: int | None = None
    edges: DataFrame | None = field(default=None)
    one_row_per_edge: bool = False
    metrics: bool = False

    def where(self, condition: Column) -> ElementQuery:
        return replace(self, conditions=(*self.conditions, condition))

    def project(self, project_id: str) -> ElementQuery:
        return self.where(F.col("project_id") == project_id)

    def types(self, *kinds: str) -> ElementQuery:
        """Elements of one of the types; no type given is no condition."""
        return self.where(F.col("element_type").isin(*kinds)) if kinds else self

    def visibility(self, kind: str) -> ElementQuery:
        return self.where(F.col("visibility") == kind)

    def public(self) -> ElementQuery:
        return self.visibility("Public")

    def complexity_between(self, low: int, high: int) -> ElementQuery:
        return self.where(F.col("complexity").between(low, high))

    def more_complex_than(self, bound: int) -> ElementQuery:
        return self.where(F.coalesce(F.col("complexity"), F.lit(1)) > bound)

    def name_like(self, part: str) -> ElementQuery:
        """Names that hold ``part`` in any case; % and _ are wildcards in it."""
        return self.where(F.col("name").ilike(f"%{part}%"))

    def documented(self, wanted: bool = True) -> ElementQuery:
        has = F.coalesce(F.size("doc_comments"), F.lit(0)) > 0
        return self.where(has if wanted else ~has)

    def with_attribute(self, part: str) -> ElementQuery:
        return self.where(F.exists("attributes", lambda a: a.contains(part)))

    def with_dependencies(self) -> ElementQuery:
        return self.where(F.size("dependencies") > 0)

    def depends_on(self, name: str) -> ElementQuery:
        return self.where(F.array_contains("dependencies", name))

    def in_lines(self, first: int, last: int) -> ElementQuery:
        return self.where((F.col("line_start") >= first) & (F.col("line_end") <= last))

    def without_tests(self) -> ElementQuery:
        return self.where(~is_test())

    def order_by(self, column: str, descending: bool = False) -> ElementQuery:
        if column not in SORTABLE:
            raise ValueError(f"can't order by {column!r}")
        c = F.col(column)
        return replace(self, order=(*self.order, c.desc() if descending else c.asc()))

    def limit(self, n: int) -> ElementQuery:
        return replace(self, most=n)

    def with_relationships(self, edges: DataFrame, one_row_per_edge: bool = False) -> ElementQuery:
        """Attach outgoing edges as an array, or repeat the element for each."""
        return replace(self, edges=edges, one_row_per_edge=one_row_per_edge)

    def with_metrics(self) -> ElementQuery:
        return replace(self, metrics=True)

    def run(self) -> DataFrame:
        df = self.elements
        for c in self.conditions:
            df = df.where(c)
        if self.metrics:
            score = scores.overall_score(F.col("cyclomatic"), F.col("cognitive"), F.col("nesting_depth"), F.col("return_count"))
            df = df.withColumns({"overall_score": score, "complexity_level": scores.level(score)})
        if self.edges is not None:
            e = self.edges.select(F.col("src").alias("_src"), "dst", "kind", "rel_type")
            if self.one_row_per_edge:
                df = df.join(e, F.col("element_id") == F.col("_src"), "left").drop("_src", "dst", "kind", "rel_type")
            else:
                grouped = e.groupBy("_src").agg(F.sort_array(F.collect_list(F.struct("dst", "kind", "rel_type"))).alias("relationships"))
                df = df.join(grouped, F.col("element_id") == F.col("_src"), "left").drop("_src")
        if self.order:
            df = df.orderBy(*self.order)
        return df if self.most is None else df.limit(self.most)


def is_test() -> Column:
    return F.lower("name").contains("test") | F.coalesce(F.exists("attributes", lambda a: a.contains("test")), F.lit(False))


def flags() -> dict[str, Column]:
    """Booleans that follow from an element's visibility, attributes, signature."""
    has = lambda part: F.coalesce(F.exists("attributes", lambda a: a.contains(part)), F.lit(False))
    word = lambda w: F.coalesce(F.col("signature").rlike(rf"\b{w}\b"), F.lit(False))
    return {"is_public": F.col("visibility") == "Public", "is_test": has("test"), "is_deprecated": has("deprecated"), "is_async": word("async"), "is_unsafe": word("unsafe")}


def chunk_candidates(elements: DataFrame, include_private: bool = False, least_complexity: int = 0, include_tests: bool = False) -> DataFrame:
    q = ElementQuery(elements)
    if not include_private:
        q = q.public()
    if not include_tests:
        q = q.without_tests()
    return q.where(F.coalesce(F.col("complexity"), F.lit(0)) >= least_complexity).run()


def children(elements: DataFrame) -> DataFrame:
    """Elements with the ids of their children, in source order."""
    own = elements.where("parent_id IS NOT NULL").groupBy(F.col("relative_path").alias("_path"), F.col("parent_id").alias("_parent"))
    lists = own.agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "element_id"))), lambda x: x["element_id"]).alias("children_ids"))
    joined = elements.join(lists, (F.col("relative_path") == F.col("_path")) & (F.col("element_id") == F.col("_parent")), "left").drop("_path", "_parent")
    return joined.withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def resolve_references(references: DataFrame, elements: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``to_element_id`` for references: by alias, name, then scope::name.

    The first registered element of a name wins; targets are looked for in the
    same file.
    """
    names = elements.select(F.col("relative_path").alias("_f"), F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("_n"), "element_id", "ordinal")
    first = names.groupBy("_f", "_n").agg(F.min_by("element_id", "ordinal").alias("_id"))
    text = F.col("reference_text")
    refs = references.drop("to_element_id", "is_resolved")
    if imports is not None:
        used = imports.select(F.col("relative_path").alias("_if"), F.explode("imported_items").alias("_item"), "alias", "module_path")
        used = used.groupBy("_if", F.coalesce("alias", "_item").alias("_local")).agg(F.min("_item").alias("_real"))
        refs = refs.join(used, (F.col("relative_path") == F.col("_if")) & (text == F.col("_local")), "left")
        refs = refs.withColumn("_text", F.coalesce("_real", text)).drop("_if", "_local", "_real")
    else:
        refs = refs.withColumn("_text", text)
    direct = first.select(F.col("_f").alias("_f1"), F.col("_n").alias("_n1"), F.col("_id").alias("_a"))
    scoped = first.select(F.col("_f").alias("_f2"), F.col("_n").alias("_n2"), F.col("_id").alias("_b"))
    refs = refs.join(direct, (F.col("relative_path") == F.col("_f1")) & (F.col("_text") == F.col("_n1")), "left")
    refs = refs.join(scoped, (F.col("relative_path") == F.col("_f2")) & (F.concat_ws("::", "scope", "_text") == F.col("_n2")), "left")
    to = F.coalesce("_a", "_b")
    return refs.withColumns({"to_element_id": to, "is_resolved": to.isNotNull()}).drop("_f1", "_n1", "_a", "_f2", "_n2", "_b", "_text")

"""Graphs of elements: building edges, paths, levels, cycles, components.

Edges have src, dst and any of kind, weight, count. Reverse questions swap the
two columns (``reversed_edges``). Paths grow by one edge a round; reachability and
distance go level by level over distinct vertices, so dense graphs don't
explode; trees double their known ancestors each round. Every round ends in a
checkpoint, so nothing is bound by Spark's limits on recursive queries.
"""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text


def _checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; one machine may go without."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairnlight-graph-"))
    return df.checkpoint(eager=True)


#: Vertices up to which a set of them goes to the edges, instead of the edges to it.
BROADCAST_NODES = 500_000


def _few(nodes: DataFrame) -> DataFrame:
    """``nodes``, stored rows by vertex, to be broadcast if there aren't many."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def reversed_edges(edges: DataFrame) -> DataFrame:
    swapped = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns])


def call_edges(references: DataFrame, elements: DataFrame) -> DataFrame:
    """(src, dst, call_type, call_count, call_sites, is_recursive) of resolved calls.

    Both ends are functions. The first site's call type counts for the pair.
    """
    fn = elements.where("element_type = 'Function'").select("element_id")
    calls = references.where("reference_type = 'FunctionCall' AND is_resolved").select(F.col("from_element_id").alias("src"), F.col("to_element_id").alias("dst"), "line", "reference_text")
    calls = calls.join(fn.withColumnRenamed("element_id", "src"), "src", "left_semi").join(fn.withColumnRenamed("element_id", "dst"), "dst", "left_semi")
    df = calls.groupBy("src", "dst").agg(F.min_by(text.call_type(F.col("reference_text")), F.struct("line", "reference_text")).alias("call_type"), F.count("*").alias("call_count"), F.sort_array(F.collect_list("line")).alias("call_sites"))
    return df.withColumn("is_recursive", F.col("src") == F.col("dst"))


def dependency_edges(references: DataFrame, elements: DataFrame) -> DataFrame:
    """Dependencies by (src, dst, type), with strength and directness."""
    ids = elements.select("element_id").hint("shuffle_hash")  # far fewer than references, which then need no sorting
    deps = references.where(F.col("reference_type").isin("TypeUsage", "VariableAccess", "ModuleReference") & F.col("is_resolved"))
    deps = deps.select(F.col("from_element_id").alias("src"), F.col("to_element_id").alias("dst"), "reference_type")
    deps = deps.join(ids.withColumnRenamed("element_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("element_id", "dst"), "dst", "left_semi")
    df = deps.groupBy("src", "dst", F.col("reference_type").alias("dependency_type")).agg(F.count("*").alias("n"))
    return df.withColumns({"strength": scores.dependency_strength(F.col("dependency_type")), "is_direct": F.col("dependency_type") != "ModuleReference"})


def type_edges(references: DataFrame, elements: DataFrame) -> DataFrame:
    types = elements.where(F.col("element_type").isin("Struct", "Enum", "Trait")).select("element_id")
    refs = references.where(F.col("reference_type").isin("TraitImplementation", "TypeUsage") & F.col("is_resolved"))
    refs = refs.select(F.col("from_element_id").alias("src"), F.col("to_element_id").alias("dst"), "reference_type", "reference_text")
    refs = refs.join(types.withColumnRenamed("element_id", "src"), "src", "left_semi").join(types.withColumnRenamed("element_id", "dst"), "dst", "left_semi")
    kind = F.when(F.col("reference_type") == "TraitImplementation", "implements").otherwise("uses")
    return refs.select("src", "dst", kind.alias("rel_type"), scores.relationship_strength(kind).alias("strength"), text.generic_constraints(F.col("reference_text")).alias("generic_constraints")).distinct()


def named(edges: DataFrame, elements: DataFrame, id_col: str = "element_id", name_col: str = "name") -> DataFrame:
    """Edges with the names of both ends."""
    v = elements.select(F.col(id_col).alias("_id"), F.col(name_col).alias("_name"))
    df = edges.join(v.withColumnsRenamed({"_id": "src", "_name": "src_name"}), "src")
    return df.join(v.withColumnsRenamed({"_id": "dst", "_name": "dst_name"}), "dst")


def paths(edges: DataFrame, starts: DataFrame, max_depth: int | None, keep: Column | None = None) -> DataFrame:
    """(start, node, depth, path) of all simple paths from ``starts`` (node).

    Depth counts edges, from 0 at the start to ``max_depth``, or to the end of
    all paths if that is None. ``keep`` is a condition on the edges followed;
    the start itself need not meet it.
    """
    used = _checkpointed((edges if keep is None else edges.where(keep)).select("src", "dst").distinct())
    front = _checkpointed(starts.select("node").distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    out = front
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(used, (F.col("node") == F.col("src")) & ~F.array_contains("path", F.col("dst")))
        front = _checkpointed(step.select("start", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("dst")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def all_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int | None) -> DataFrame:
    """Simple paths from the starts to ``ends`` (node), with their number of vertices.

    A path stops at the first end that it meets.
    """
    goals = _checkpointed(ends.select(F.col("node").alias("goal")).distinct())
    found = paths(edges.join(goals, F.col("src") == F.col("goal"), "left_anti"), starts, max_depth)
    return found.where("depth > 0").join(goals, F.col("node") == F.col("goal"), "left_semi").select("start", "path", F.size("path").alias("length"))


def hierarchy(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, parent, name, depth, path) from all roots down; ``nodes`` is a tree.

    Each round joins a node's known line of ancestors with that of its topmost
    one, so the rounds are the logarithm of the depth. Nodes that no root
    reaches (whose parents are missing or form a ring) are left out.
    """
    rows = nodes.select("id", "parent", "name", F.col("parent").alias("top"), F.array("name").alias("path"))
    done, open_rows = _checkpointed(rows.where("top IS NULL")), _checkpointed(rows.where("top IS NOT NULL"))
    while not open_rows.isEmpty():
        above = done.unionByName(open_rows).select(F.col("id").alias("up"), F.col("top").alias("next"), F.col("path").alias("line"))
        grown = _checkpointed(open_rows.join(above, F.col("top") == F.col("up")).select("id", "parent", "name", F.col("next").alias("top"), F.concat("line", "path").alias("path")))
        ended = grown.where("top IS NULL")
        if ended.isEmpty():
            break
        done, open_rows = done.unionByName(ended), grown.where("top IS NOT NULL")
    out = done.select("id", "parent", "name", (F.size("path") - 1).alias("depth"), "path")
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def levels(edges: DataFrame, starts: DataFrame, max_depth: int | None, inclusive: bool = True) -> DataFrame:
    """(node, depth, via): the least depth of every vertex that is reached.

    ``via`` is the lowest predecessor on a shortest path. With ``inclusive``
    off, vertices at ``max_depth`` are left out. None goes on to the last vertex.
    """
    used = _checkpointed(edges.select("src", "dst").distinct())
    seen = _checkpointed(starts.select("node", F.lit(0).alias("depth"), F.lit(None).cast(used.schema["src"].dataType).alias("via")).distinct())
    depths = itertools.count(1) if max_depth is None else range(1, max_depth + inclusive)
    for depth in depths:
        frontier = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        found = used.join(frontier, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        found = _checkpointed(found.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "via"))
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
    return seen


def discovered_edges(edges: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """(src, dst, depth): all edges out of vertices reached before ``max_depth``, if any."""
    reached = levels(edges, starts, None if max_depth is None else max_depth - 1).select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    return edges.select("src", "dst").distinct().join(reached, "src").select("src", "dst", "depth")


def max_depth(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """One row: the largest number of edges of a walk from the starts.

    It is null if a cycle can be reached, as there is no largest then.
    """
    reached = levels(edges, starts, None).select(F.col("node").alias("src"))
    used = _checkpointed(edges.select("src", "dst").distinct().join(reached, "src", "left_semi"))
    if not _trimmed(used.where("src <> dst")).isEmpty() or not used.where("src = dst").isEmpty():
        return edges.sparkSession.createDataFrame([(None,)], "max_depth int")
    frontier, depth = _checkpointed(starts.select("node").distinct()), 0
    while True:
        frontier = _checkpointed(used.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct())
        if frontier.isEmpty():
            break
        depth += 1
    return edges.sparkSession.createDataFrame([(depth,)], "max_depth int")


def shortest_paths(edges: DataFrame, starts: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, distance, path, edge_count): least total weight, ties by path.

    Without ``weight`` every edge counts 1. Weights must not be negative; rounds
    go on until nothing gets nearer.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    used = _checkpointed(edges.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    if not used.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    best = _checkpointed(starts.select("node", F.lit(0.0).alias("distance"), F.array("node").alias("path")).distinct())
    changed = best
    while not changed.isEmpty():
        step = used.join(changed, (F.col("src") == F.col("node")) & ~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.array_append("path", F.col("dst")).alias("path"))
        merged = best.withColumn("old", F.lit(1)).unionByName(step.withColumn("old", F.lit(0)))
        pick = merged.groupBy("node").agg(F.min(F.struct("distance", "path")).alias("m"), F.min(F.when(F.col("old") == 1, F.struct("distance", "path"))).alias("was"))
        pick = _checkpointed(pick)
        best = pick.select("node", "m.*")
        changed = pick.where(F.col("was").isNull() | (F.col("m") < F.col("was"))).select("node", "m.*")
    return best.withColumn("edge_count", F.size("path") - 1)


def dfs_order(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, depth, position): vertices as a depth-first walk meets them.

    Neighbours are tried in order; the way to a vertex is then the least of its
    simple paths, and the walk meets vertices in the order of these. Paths are
    followed to ``max_depth`` edges, inclusive.
    """
    least = paths(edges, starts, max_depth).groupBy("start", "node").agg(F.min("path").alias("path"))
    position = F.row_number().over(Window.partitionBy("start").orderBy("path"))
    return least.select("start", "node", (F.size("path") - 1).alias("depth"), position.alias("position"))


def trace_calls(calls: DataFrame, starts: DataFrame, max_depth: int | None, backward: bool = False) -> DataFrame:
    """(start, node, depth, path) of the calls out of the starts, or into them."""
    return paths(reversed_edges(calls.select("src", "dst")) if backward else calls, starts, max_depth).where("depth > 0")


def call_chain_analysis(calls: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """A row for each start: forward and backward paths, recursion, depth, total.

    ``max_depth`` of the result is that of the forward paths, ``total_calls``
    their number and that of the backward ones.
    """
    starts = _checkpointed(starts.select("node").distinct())
    forward = trace_calls(calls, starts, max_depth).groupBy("start").agg(F.count("*").alias("forward_calls"), F.max("depth").alias("max_depth"))
    backward = trace_calls(calls, starts, max_depth, True).groupBy("start").agg(F.count("*").alias("backward_calls"))
    recursive = calls.where("src = dst").groupBy(F.col("src").alias("start")).agg(F.count("*").alias("recursive_calls"))
    out = starts.select(F.col("node").alias("start")).join(forward, "start", "left").join(backward, "start", "left").join(recursive, "start", "left").fillna(0)
    return out.withColumn("total_calls", F.col("forward_calls") + F.col("backward_calls"))


def checked_ends(edges: DataFrame, elements: DataFrame, id_col: str = "element_id") -> DataFrame:
    """``edges``, both of whose ends must be elements; one that isn't is an error.

    The error comes when the rows are computed and names the missing end.
    """
    ids = elements.select(F.col(id_col).alias("_id"), F.lit(True).alias("_there")).distinct()
    for end in ("src", "dst"):
        found = edges.join(ids, F.col(end) == F.col("_id"), "left")
        message = F.concat(F.lit(f"no element for {end} "), F.coalesce(F.col(end).cast("string"), F.lit("null")))
        edges = found.withColumn(end, F.when(F.col("_there"), F.col(end)).otherwise(F.raise_error(message).cast(edges.schema[end].dataType))).drop("_id", "_there")
    return edges


def direct_edges(edges: DataFrame, node, incoming: bool = False) -> DataFrame:
    """The direct edges out of one element, or into it."""
    return edges.where((F.col("dst" if incoming else "src") == node) & F.col("is_direct"))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(cycle, length, strength): simple cycles once each, the least vertex first.

    Cycles of up to ``longest`` vertices are listed; their number grows without
    measure with it. Only edges inside a strongly connected component are
    followed. ``cyclic_components`` tells all vertices on cycles of any length.
    """
    e = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if longest > 3:
        parts = _checkpointed(cyclic_components(e).select("node", "component"))
        ends = e.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        e = _checkpointed(ends.where("a = b").select("src", "dst"))
    open_paths = e.select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")).where("dst > src")
    out = e.where("src = dst").select(F.array("src").alias("cycle"))
    for length in range(2, longest + 1):
        back = e.select(F.col("src").alias("s"), F.col("dst").alias("d"))
        out = out.unionByName(open_paths.join(back, (F.col("last") == F.col("s")) & (F.col("first") == F.col("d"))).select(F.col("path").alias("cycle")))
        if length < longest:
            grown = open_paths.join(back, (F.col("last") == F.col("s")) & (F.col("d") > F.col("first"))).where(~F.array_contains("path", F.col("d")))
            open_paths = grown.select("first", F.col("d").alias("last"), F.array_append("path", F.col("d")).alias("path"))
            open_paths = _checkpointed(open_paths) if longest > 3 else open_paths
    return out.withColumns({"length": F.size("cycle"), "strength": 1 / F.size("cycle")})


def _continued(edges: DataFrame, end: str) -> DataFrame:
    """The edges whose ``end`` is the other end of an edge too; ``edges`` is read twice."""
    others = _checkpointed(edges.select(F.col("dst" if end == "src" else "src").alias(end)).distinct())
    return edges.join(_few(others), end, "left_semi").select("src", "dst")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges left when those out of sources and into sinks go, again and again."""
    count, unchanged = None, 0
    for end in itertools.cycle(("src", "dst")):
        edges = _checkpointed(_continued(edges, end))
        before, count = count, edges.count()
        unchanged = unchanged + 1 if count == before else 0
        if not count or unchanged == 2:
            return edges


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of every vertex on a cycle of any length.

    Components are strongly connected ones, named by their least vertex; one of
    a single vertex is an edge to itself. The least vertex that reaches each
    vertex is spread forwards; of those with the same one, the vertices that
    reach it in turn are its component, which is set aside until no edges remain.
    ``edges`` is read twice and only what doesn't begin at a source is stored, so
    edges that are dear to compute should be stored before.
    """
    edges = _checkpointed(_continued(edges.where("src IS NOT NULL AND dst IS NOT NULL"), "src").distinct())
    out = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left = _trimmed(edges.where("src <> dst"))
    while not left.isEmpty():
        least = _checkpointed(left.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
        changed = least
        while not changed.isEmpty():
            step = left.join(changed, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("new"))
            merged = _checkpointed(least.join(step, "node", "left").withColumn("lower", F.coalesce(F.col("new") < F.col("component"), F.lit(False))))
            least = merged.select("node", F.least("component", "new").alias("component"))
            changed = merged.where("lower").select("node", F.col("new").alias("component"))
        ends = left.join(least.select(F.col("node").alias("src"), "component"), "src")
        inside = _checkpointed(ends.join(least.select(F.col("node").alias("dst"), "component"), ["dst", "component"]))
        found = frontier = _checkpointed(least.where("node = component"))
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "component").distinct()
            frontier = _checkpointed(back.join(found, "node", "left_anti"))
            found = found.unionByName(frontier)
        found = _checkpointed(found)
        out = out.unionByName(found.join(found.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component"))
        for end in ("src", "dst"):
            left = left.join(found.select(F.col("node").alias(end)), end, "left_anti")
        left = _trimmed(_checkpointed(left.select("src", "dst")))
    out = out.groupBy("node").agg(F.min("component").alias("component"))
    return out.join(out.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def dependency_analysis(edges: DataFrame) -> DataFrame:
    """The ten sources with the most edges, ties by id; for all, ``dependency_totals``."""
    by = edges.groupBy("src").agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "src").limit(10)


def dependency_totals(edges: DataFrame) -> DataFrame:
    """One row over all edges (src, dst, is_direct).

    An edge is cyclic if it lies on a cycle of any length; ``cyclic_components``
    counts the separate groups of those. A stored edge has path length 1.
    """
    edges = _checkpointed(edges.select("src", "dst", "is_direct"))
    groups = _checkpointed(cyclic_components(edges))
    a, b = (_few(groups.select(F.col("node").alias(end), F.col("component").alias(c))) for end, c in (("src", "a"), ("dst", "b")))
    ends = edges.join(a, "src", "left").join(b, "dst", "left")
    totals = ends.agg(F.count("*").alias("total"), F.count_if("is_direct").alias("direct"), F.count_if(F.col("a") == F.col("b")).alias("cyclic"), F.avg(F.lit(1.0)).alias("average_path_length"))
    return totals.crossJoin(groups.agg(F.countDistinct("component").alias("cyclic_components")))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))


def neighbours(calls: DataFrame, dependencies: DataFrame, types: DataFrame, traversal: str) -> DataFrame:
    """The edge view of a traversal kind, as (src, dst, weight)."""
    if traversal in ("CallChains", "CallersChain"):
        e = calls.select("src", "dst", F.lit(1.0).alias("weight"))
        return reversed_edges(e) if traversal == "CallersChain" else e
    if traversal in ("Dependencies", "Dependents"):
        e = dependencies.where("is_direct").select("src", "dst", F.col("strength").alias("weight"))
        return reversed_edges(e) if traversal == "Dependents" else e
    if traversal == "TypeRelationships":
        return types.select("src", "dst", F.col("strength").alias("weight"))
    raise ValueError(f"no traversal {traversal!r}")


def build_stats(calls: DataFrame, dependencies: DataFrame, types: DataFrame, functions: DataFrame) -> DataFrame:
    """One row (as graphs are built): sizes of the three edge tables.

    ``functions`` are the elements that may call; depths are most edges into
    or out of one vertex's chain and are left to ``max_depth``.
    """
    c = calls.agg(F.count("*").alias("call_chains"), F.count_if(F.col("src") == F.col("dst")).alias("recursive_calls"), F.coalesce(F.max("call_count"), F.lit(0)).alias("most_calls"))
    d = dependencies.agg(F.count("*").alias("dependencies"), F.countDistinct("src").alias("dependent_elements"), F.count_if("is_direct").alias("direct_dependencies"))
    t = types.agg(F.count("*").alias("type_relationships"), F.count_if(F.col("rel_type") == "implements").alias("implementations"), F.countDistinct("src").alias("related_types"))
    return functions.agg(F.count("*").alias("functions")).crossJoin(c).crossJoin(d).crossJoin(t)

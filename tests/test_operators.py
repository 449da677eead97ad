import math
import random

import pytest
from pyspark.sql import functions as F

from cairnlight.functions import scores, text
from cairnlight.operators import analyzers, elements, graph, metrics, rag, search
from cairnlight.plans import views

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: text.camel_to_snake(F.lit("camelCaseÜber")), "camel_case_über"),
        (lambda: text.snake_to_camel(F.lit("snake__case_x")), "snakeCaseX"),
        (lambda: text.words(F.lit("hello-world_test Été")), ["hello", "world", "test", "été"]),
        (lambda: text.token_estimate(F.lit("ééé")), 2),
        (lambda: text.token_estimate_floor(F.lit("a"), 10), 10),
        (lambda: text.generic_constraints(F.lit("Vec<String, Clone>")), ["String", "Clone"]),
        (lambda: text.call_type(F.lit("a::b.c")), "static"),
        (lambda: text.jaccard(F.array(), F.array()), 1.0),
        (lambda: text.anchor(F.lit("src/a.rs")), "srcars"),
        (lambda: text.documentation_only(F.lit("/// a\nx\n//! b")), "a b"),
        (lambda: scores.health(F.lit(0.9), F.lit(5.0)) > 0.7, True),
        (lambda: scores.health(F.lit(0.1), F.lit(30.0)) < 0.5, True),
        (lambda: scores.level(F.lit(51)), "VeryHigh"),
        (lambda: scores.ratio(F.lit(1), F.lit(0)), 0.0),
        (lambda: scores.structural(F.lit("Enum"), F.lit(0), F.lit(4), F.lit(3), F.lit(0), F.lit(0), F.lit(0))[1], 7),
        (lambda: scores.visibility_kind(F.lit("pub(crate)")), "Restricted"),
        (lambda: text.path_matches(F.lit("src/a/b.rs"), "src/**/*.rs", True), True),
        (lambda: text.path_matches(F.lit("src/b.rs"), "src/**/*.rs", True), True),
        (lambda: text.path_matches(F.lit("x/src/b.rs"), "src/**/*.rs", True), False),
        (lambda: text.path_matches(F.lit("x/y.rs"), "**/y*.rs"), True),
        (lambda: text.path_included(F.lit("target/x.rs"), ["**"], ["target/**"]), False),
    ],
)
def test_columns(spark, column, want):
    assert value(spark, column()) == want


def test_median_and_quartiles(spark):
    for values, want in (([1, 2, 3, 4, 5], (3, 1.5, 4.5)), ([4.0], (4, None, None)), ([1, 2, 3, 4], (2.5, 1.5, 3.5))):
        r = metrics.spread(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()
        assert (r["median"], r["q1"], r["q3"]) == want


def test_query_is_lazy_and_safe(spark):
    q = elements.ElementQuery(views.elements(spark, SF))
    with pytest.raises(ValueError):
        q.order_by("name; DROP TABLE x")
    e = spark.createDataFrame([("1", "2", "call", "direct"), ("1", "3", "call", "direct")], "src string, dst string, kind string, rel_type string")
    one = q.where(F.col("element_id") == "1")
    assert one.with_relationships(e, one_row_per_edge=True).run().count() == 2
    assert len(one.with_relationships(e).run().first()["relationships"]) == 2
    assert "overall_score" in q.with_metrics().run().columns


def random_edges(seed, n=14, m=28):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def brute_paths(edges, start, depth):
    out, stack = [], [[start]]
    while stack:
        p = stack.pop()
        out.append(tuple(p))
        if len(p) <= depth:
            stack += [[*p, b] for a, b in edges if a == p[-1] and b not in p]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    edges = random_edges(seed)
    df, start = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "node long")
    simple = brute_paths(edges, 0, 4)
    assert sorted(tuple(r["path"]) for r in graph.paths(df, start, 4).collect()) == sorted(simple)
    assert sorted(tuple(r["path"]) for r in graph.all_paths(df, start, spark.createDataFrame([(5,)], "node long"), 4).collect()) == sorted(p for p in simple if p[-1] == 5 and len(p) > 1)
    depth = {}
    for p in sorted(brute_paths(edges, 0, 14), key=len):
        depth.setdefault(p[-1], len(p) - 1)
    assert {r["node"]: r["depth"] for r in graph.levels(df, start, 50).collect()} == depth
    assert {r["node"] for r in graph.levels(df, start, 2, inclusive=False).collect()} == {v for v, d in depth.items() if d < 2}
    assert {(r["src"], r["dst"]) for r in graph.discovered_edges(df, start, 2).collect()} == {(a, b) for a, b in edges if depth.get(a, 9) < 2}
    found = {tuple(r["cycle"]) for r in graph.cycles(df, 4).collect()}
    want = {p for v in {a for a, _ in edges} for p in brute_paths(edges, v, 3) if (p[-1], v) in edges and min(p) == v}
    assert found == want
    weights = {e: random.Random(str(e)).randint(1, 9) for e in edges}
    weighted = spark.createDataFrame([(a, b, float(w)) for (a, b), w in weights.items()], "src long, dst long, w double")
    best = {}
    for p in brute_paths(edges, 0, 14):
        d = float(sum(weights[x] for x in zip(p, p[1:])))
        best[p[-1]] = min(best.get(p[-1], 1e9), d)
    assert {r["node"]: r["distance"] for r in graph.shortest_paths(weighted, start, "w").collect()} == best


def test_dag_has_no_cycles_and_a_depth(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert graph.cycles(df, 4).count() == 0
    assert graph.max_depth(df, spark.createDataFrame([(0,)], "node long")).first()[0] == 3
    loop = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert graph.max_depth(loop, spark.createDataFrame([(0,)], "node long")).first()[0] is None


def test_packing_against_a_loop(spark):
    rng = random.Random(5)
    items = [(g, o, rng.choice((1, 5, 40, 120))) for g in "abc" for o in range(rng.randint(1, 30))]
    got = {(r["g"], r["chunk"]): (r["items"], r["tokens"]) for r in rag.pack(spark.createDataFrame(items, "g string, o int, t int"), F.col("t"), 100, "g", "o").collect()}
    want = {}
    for g in "abc":
        chunks, n, total = [], 0, 0
        for _, _, t in sorted(i for i in items if i[0] == g):
            if n and total + t > 100:
                chunks.append((n, total))
                n, total = 0, 0
            n, total = n + 1, total + t
        chunks.append((n, total))
        want |= {(g, k): c for k, c in enumerate(chunks)}
    assert got == want


def test_registry(spark):
    registry = analyzers.default_registry()
    with pytest.raises(analyzers.AnalyzerError):
        registry.register(analyzers.Analyzer("metrics", lambda c, k: analyzers.Output()))
    registry.register(analyzers.Analyzer("broken", lambda c, k: 1 / 0))
    registry.disabled.add("doc-enhancer")
    out = registry.execute(analyzers.Context(analyzers.Phase.POST_PROJECT, views.elements(spark, SF)))
    assert "metrics.values" in out.tables and not any(k.startswith("doc-enhancer") for k in out.tables)
    assert out.messages == ["error: broken: division by zero"] and registry.stats["broken"]["failures"] == 1
    assert all(t.count() >= 0 for t in out.tables.values())
    registry.continue_on_error = False
    with pytest.raises(analyzers.AnalyzerError):
        registry.execute(analyzers.Context(analyzers.Phase.POST_PROJECT, views.elements(spark, SF)))
    registry.enabled.add("metrics")
    assert registry.active(analyzers.Phase.POST_PROJECT) == ["metrics"]


@pytest.mark.parametrize("edges", [random_edges(1), random_edges(3, 20, 24), [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5), (5, 6), (7, 5), (6, 8), (8, 6), (9, 9)], [(0, 1)]])
def test_cycles_of_any_length(spark, edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    want = {}
    for a in {a for a, b in reach if (b, a) in reach}:
        both = [b for x, b in reach if x == a and (b, a) in reach]
        want[a] = (min(both), len(both))
    got = graph.cyclic_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: (r["component"], r["size"]) for r in got} == want and len(got) == len(want)


def test_walks_without_a_depth_are_whole(spark):
    edges = [(k, k + 1) for k in range(12)] + [(3, 7), (12, 0)]
    df, start = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "node long")
    simple = brute_paths(edges, 0, 99)
    assert max(map(len, simple)) == 13
    assert sorted(tuple(r["path"]) for r in graph.paths(df, start, None).collect()) == sorted(simple)
    depth = {}
    for p in sorted(simple, key=len):
        depth.setdefault(p[-1], len(p) - 1)
    assert {r["node"]: r["depth"] for r in graph.levels(df, start, None).collect()} == depth
    assert {(r["src"], r["dst"], r["depth"]) for r in graph.discovered_edges(df, start, None).collect()} == {(a, b, depth[a] + 1) for a, b in edges}


def test_dependency_totals(spark):
    edges = [(0, 1, True), (1, 2, True), (2, 3, False), (3, 0, True), (3, 4, True), (4, 4, True), (5, 0, False), (0, 1, False)]
    row = graph.dependency_totals(spark.createDataFrame(edges, "src long, dst long, is_direct boolean")).first().asDict()
    assert row == {"total": 8, "direct": 5, "cyclic": 6, "average_path_length": 1.0, "cyclic_components": 2}
    none = graph.dependency_totals(spark.createDataFrame([], "src long, dst long, is_direct boolean")).first()
    assert none["total"] == 0 and none["average_path_length"] is None


@pytest.mark.parametrize("few", [0, 500_000])
def test_edges_of_sources_are_stored_once(spark, monkeypatch, few):
    stored, store = [], graph._checkpointed

    def counted(df):
        stored.append((kept := store(df)).count())
        return kept

    monkeypatch.setattr(graph, "_checkpointed", counted)
    monkeypatch.setattr(graph, "BROADCAST_NODES", few, raising=False)
    ring = [(0, 1), (1, 2), (2, 0), (0, 1), (2, 3), (3, 3), (3, 4), (4, 5), (None, 0), (1, None)]
    edges = [(a, b, k % 2 == 0) for k, (a, b) in enumerate([*ring, *((k, k % 3) for k in range(6, 1006))])]
    row = graph.dependency_totals(spark.createDataFrame(edges, "src long, dst long, is_direct boolean")).first().asDict()
    assert row == {"total": 1010, "direct": 505, "cyclic": 5, "average_path_length": 1.0, "cyclic_components": 2}
    assert stored[0] == 1010 and max(stored[1:]) < 50


def test_deep_and_wide_trees(spark):
    deep = [(0, None, "n0")] + [(i, i - 1, f"n{i}") for i in range(1, 151)] + [(900, 901, "ring"), (901, 900, "ring"), (902, 903, "lost")]
    out = {r["id"]: (r["depth"], r["path"]) for r in graph.hierarchy(spark.createDataFrame(deep, "id long, parent long, name string")).collect()}
    assert out == {i: (i, [f"n{k}" for k in range(i + 1)]) for i in range(151)}
    assert graph.hierarchy(spark.createDataFrame(deep, "id long, parent long, name string"), 3).count() == 4
    wide = spark.range(1_200_000).selectExpr("id", "CASE WHEN id > 0 THEN (id - 1) DIV 1100 END AS parent", "CAST(id AS STRING) AS name")
    row = graph.hierarchy(wide).selectExpr("count(*) AS n", "max(depth) AS d").first()
    assert row["n"] == 1_200_000 and row["d"] == 2
    assert graph.hierarchy(wide.limit(0)).count() == 0


def test_long_chains(spark):
    chain = spark.range(130).selectExpr("id AS src", "id + 1 AS dst")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.shortest_paths(chain, start).selectExpr("max(distance)").first()[0] == 130
    with pytest.raises(ValueError):
        graph.shortest_paths(chain.withColumn("w", F.lit(-1)), start, "w")


def test_call_chains_and_checked_ends(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (2, 2), (4, 2), (3, 4)], "src long, dst long")
    row = graph.call_chain_analysis(calls, spark.createDataFrame([(2,), (9,)], "node long"), 10).orderBy("start").collect()
    assert [tuple(r) for r in row] == [(2, 2, 2, 3, 1, 5), (9, 0, 0, 0, 0, 0)]
    assert {r["node"] for r in graph.trace_calls(calls, spark.createDataFrame([(2,)], "node long"), 1, backward=True).collect()} == {1, 4}
    elements = spark.createDataFrame([(1,), (2,), (3,)], "element_id long")
    assert graph.checked_ends(calls.where("src < 3 AND dst < 4"), elements).count() == 3
    with pytest.raises(Exception, match="no element for src 4"):
        graph.checked_ends(calls, elements).collect()
    order = graph.dfs_order(calls, spark.createDataFrame([(1,)], "node long"), 9).orderBy("position").collect()
    assert [(r["node"], r["depth"]) for r in order] == [(1, 0), (2, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("prefix", [False, True])
def test_ranked_search_sums_only_what_is_asked(spark, prefix):
    rows = [("1", "red_bolt", "m::red_bolt", None, ["A red bolt.", "Example: `red`"]), ("2", "blue", "m::blue", "fn blue()", []), ("3", "x", "m::x", None, ["example red"]), ("3", "x", "m::x", None, ["redder"])]
    df = spark.createDataFrame(rows, "element_id string, name string, qualified_name string, signature string, doc_comments array<string>").coalesce(1)
    found = search.ranked(search.weighted_postings(df), "The Reds, examples", prefix)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lowest = max(k for k, line in enumerate(plan.splitlines()) if "Aggregate [" in line and "element_id" in line)
    below = plan.splitlines()[lowest:]
    assert any("Filter" in line and "word#" in line and "example" in line and "red)" in line for line in below)  # the words are chosen before any sum
    assert any("RepartitionByExpression [element_id" in line for line in below)  # and the rows spread before they are words
    two, once = 1 + math.log(2), 1 + math.log(1)
    want = {"1": 1.4 + 0.1 * two + 0.1 * once, "3": 0.2 * once + (0.1 if prefix else 0)}
    got = {r["element_id"]: r["rank"] for r in found.collect()}
    assert got == pytest.approx(want) and [r["element_id"] for r in found.collect()] == ["1", "3"]
    assert search.ranked(search.weighted_postings(df), "the", prefix).count() == 0


def test_names_across_modules(spark):
    from cairnlight.operators import namespaces as ns

    rows = [("a", "f", "m::f", "Public", None, "x.rs", 0), ("b", "g", "m::g", "Restricted", "crate", "x.rs", 1), ("c", "h", "m::h", "Restricted", "in m::n", "x.rs", 2), ("d", "k", "m::k", "Private", None, "x.rs", 3), ("e", "s", "m::s", "Restricted", "super", "x.rs", 4)]
    e = spark.createDataFrame(rows, "element_id string, name string, qualified_name string, visibility string, visibility_scope string, relative_path string, ordinal int")
    got = {r["simple_name"]: (r["is_public"], r["scope"]) for r in ns.namespaces(e).collect()}
    assert got == {"f": (True, "Public"), "g": (False, "Crate"), "h": (False, "m::n"), "k": (False, "Private"), "s": (False, "Super")}
    open_to = lambda place: {r["simple_name"] for r in ns.namespaces(e).where(ns.accessible_from(F.col("scope"), F.col("canonical_path"), F.lit(place))).collect()}
    assert open_to("m::n::deep") == {"f", "g", "h"} and open_to("m::k") == {"f", "g", "k"} and open_to("m::s::in") == {"f", "g", "s"}
    imports = spark.createDataFrame([("x.rs", "m", ["f"], False, "ff"), ("x.rs", "std::io", ["Read", "Write"], False, None), ("x.rs", "m", [], True, None), ("x.rs", "serde", [], False, None)], "relative_path string, module_path string, imported_items array<string>, is_glob boolean, alias string")
    names = ns.import_names(imports)
    assert {(r["local"], r["path"]) for r in names.collect()} == {("ff", "m::f"), ("Read", "std::io::Read"), ("Write", "std::io::Write"), ("serde", "serde")}
    assert {r["canonical_path"]: r["aliases"] for r in ns.aliases(e, names).collect()}["m::f"] == ["f", "ff"]
    assert {r["reference_name"] for r in ns.reference_names(e, names).where("element_id = 'a'").collect()} == {"f", "ff", "m::f"}
    refs = spark.createDataFrame([("x.rs", t, "m::n") for t in ("ff", "g", "p::q", "z")], "relative_path string, reference_text string, scope string")
    assert {r["reference_text"]: r["canonical_path"] for r in ns.resolve(refs, names, e).collect()} == {"ff": "m::f", "g": "m::g", "p::q": "p::q", "z": "m::n::z"}
    assert value(spark, ns.path_accessible(F.lit("crate::a"), F.lit("b"))) and not value(spark, ns.path_accessible(F.lit("m::a"), F.lit("q")))


def test_schema_changes(spark, tmp_path):
    from cairnlight.operators import maintenance as mt

    (tmp_path / "c").mkdir()
    (tmp_path / "c/001_first.sql").write_text("-- Description: makes a view\nCREATE OR REPLACE TEMP VIEW ledger_v AS SELECT 1 AS x;\n-- down\nDROP VIEW ledger_v;\n")
    (tmp_path / "c/002_second.sql").write_text("-- second one\nCREATE OR REPLACE TEMP VIEW ledger_w AS SELECT x + 1 AS y FROM ledger_v\n")
    (tmp_path / "c/notes.txt").write_text("none")
    ledger = mt.Ledger(spark, str(tmp_path / "ledger"), tmp_path / "c")
    assert [c.version for c in ledger.pending()] == [1, 2] and not ledger.up_to_date() and mt.health(spark, ledger)["status"] == "Degraded"
    assert [(c.version, c.description) for c in ledger.migrate()] == [(1, "makes a view"), (2, "second one")]
    assert spark.table("ledger_w").first()["y"] == 2 and ledger.up_to_date() and mt.health(spark, ledger)["status"] == "Healthy"
    with pytest.raises(mt.MaintenanceError):
        ledger.rollback()
    (tmp_path / "c/001_first.sql").write_text("-- other\nSELECT 1;\n")
    (tmp_path / "c/002_second.sql").unlink()
    assert [tuple(r) for r in ledger.drift().collect()] == [(1, "changed"), (2, "missing")]
    (tmp_path / "c/002_second.sql").write_text("SELECT 1;\n-- rollback\nDROP VIEW ledger_w;\n")
    assert ledger.rollback().version == 2 and [r["version"] for r in ledger.applied().collect()] == [1]
    assert mt.health(spark, mt.Ledger(spark, str(tmp_path / "ledger"), tmp_path / "c"))["status"] == "Degraded"
    assert len(mt.advice("SELECT * FROM t WHERE a LIKE '%x'")) == 3 and mt.advice("SELECT a FROM t LIMIT 1") == []
    found = mt.analyzed(spark.range(10).groupBy(F.col("id") % 3).count())
    assert found["Exchange"] >= 1 and found["ms"] > 0
    assert mt.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}
    assert mt.setting({"a": 1}, "a", 5) == 1 and mt.setting({"a": "x"}, "a", 5) == 5
    with pytest.raises(mt.MaintenanceError):
        mt.require({"a": 1}, ["a", "b"])


def test_packing_by_loops(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 5, 30, 120, None])) for i in range(200)]
    want = {}
    for g in ("a", "b", None):
        chunks = [[0, 0]]
        for _, _, t in (r for r in rows if r[0] == g):
            if chunks[-1][0] and chunks[-1][1] + (t or 0) > 100:
                chunks.append([0, 0])
            chunks[-1][0] += 1
            chunks[-1][1] += t or 0
        want |= {(g, k): tuple(c) for k, c in enumerate(chunks)}
    df = spark.createDataFrame(rows, "g string, o int, t int")
    assert {(r["g"], r["chunk"]): (r["items"], r["tokens"]) for r in rag.pack(df, F.col("t"), 100, "g", "o").collect()} == want
    assert rag.pack(df.limit(0), F.col("t"), 100, "g", "o").count() == 0


def test_whole_retrieval_document(spark):
    e = views.elements(spark, SF).withColumn("parent_id", F.lit(None).cast("string"))
    parts = rag.document(e, {"name": "p"}, views.references(spark, SF))
    assert set(parts) == {"metadata", "chunks", "semantics", "examples"}
    assert parts["metadata"].count() == 1 and parts["chunks"].count() == rag.chunks(e).count() > 0

import json

import pytest
from pyspark.sql import functions as F

from cairnlight import __main__ as cli
from cairnlight.operators import elements, graph
from cairnlight.sources import config, sinks, tree
from cairnlight.streaming import ingest


@pytest.fixture
def project(tmp_path):
    files = {
        "src/main.rs": "mod util;\npub fn main() { helper(); util::go(); }\npub fn helper() { main2(); }\npub fn main2() {}\n",
        "src/util.rs": "/// Goes.\npub fn go() { go(); }\npub struct S { pub a: T }\npub struct T;\n",
        "tests/t.rs": "pub fn t() {}", "target/x.rs": "pub fn x() {}", "src/bad.rs": "pub fn (", "src/note.txt": "no",
    }
    for name, content in files.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (tmp_path / "p" / "Cargo.toml").write_text('[package]\nname = "demo"\nversion = "1.2.3"\nedition = "2018"\n')
    return str(tmp_path / "p")


def extracted(spark, root, **options):
    o = tree.ExtractOptions(**options)
    return tree.tables(tree.parse(tree.discover(spark, root, o), "demo", o))


def test_extract_project(spark, project):
    t = extracted(spark, project)
    files = {r["relative_path"]: r["error"] for r in t["files"].collect()}
    assert sorted(files) == ["src/bad.rs", "src/main.rs", "src/util.rs"] and files["src/bad.rs"] and not files["src/main.rs"]
    assert {r["name"] for r in t["elements"].collect()} == {"main", "helper", "main2", "go", "S", "T"}
    tree.check_success(t["files"], 0.5)
    with pytest.raises(tree.ExtractionError):
        tree.check_success(t["files"], 0.9)
    assert tree.manifest(spark, f"{project}/Cargo.toml", "x") == {"name": "demo", "version": "1.2.3", "rust_edition": "2018"}
    assert tree.manifest(spark, f"{project}/none.toml", "x") == {"name": "x", "version": "0.1.0", "rust_edition": "2021"}


def test_resolved_calls(spark, project):
    t = extracted(spark, project)
    refs = elements.resolve_references(t["references"], t["elements"], t["imports"])
    edges = graph.call_edges(refs, t["elements"]).join(t["elements"].select(F.col("element_id").alias("src"), F.col("name").alias("a")), "src").join(t["elements"].select(F.col("element_id").alias("dst"), F.col("name").alias("b")), "dst")
    assert {(r["a"], r["b"], r["is_recursive"]) for r in edges.collect()} == {("main", "helper", False), ("helper", "main2", False), ("go", "go", True)}
    types = graph.type_edges(refs, t["elements"])
    assert types.count() == 1 and types.first()["rel_type"] == "uses"


def test_store_load_delete(spark, project, tmp_path):
    t = extracted(spark, project)
    out = f"{tmp_path}/out"
    for p in ("one", "two"):
        sinks.store({k: t[k].withColumn("project_id", F.lit(p)) for k in ("elements", "files")}, out)
    assert sinks.load(spark, out, "elements").count() == 12
    assert sinks.delete_project(spark, out, "one") == ["elements", "files"]
    assert {r[0] for r in sinks.load(spark, out, "elements").select("project_id").distinct().collect()} == {"two"}


def test_formats(spark, project):
    t = extracted(spark, project)
    sections = [r["section"] for r in sinks.markdown(t["elements"], "demo").collect()]
    assert sections[0].startswith("# demo") and "[src/util.rs](#srcutilrs)" in sections[0] and "### go" in sections[2] and "Goes." in sections[2]
    rows = [json.loads(r[0]) for r in sinks.json_rows(t["elements"]).collect()]
    assert len(rows) == 6 and all(r["project_id"] == "demo" for r in rows)
    assert "type Query" in sinks.graphql_schema("demo")
    assert sinks.pack_messages({"a": [1, -1, "x", None, True, 1.5]}) == b"\x81\xa1a\x96\x01\xd3\xff\xff\xff\xff\xff\xff\xff\xff\xa1x\xc0\xc3\xcb?\xf8" + b"\0" * 6
    assert [len(r["elements"]) for r in sinks.reconstruct(t["elements"]).first()["files"]] == [3, 3]


def test_stream(spark, project, tmp_path):
    out = f"{tmp_path}/s"
    for _ in range(2):
        ingest.ingest(ingest.source_stream(spark, f"{project}/src"), "demo", out, f"{tmp_path}/c").awaitTermination()
    assert sinks.load(spark, out, "elements").count() == 6


def test_config(tmp_path):
    c = config.parse('include_private = true\ninclude = ["a/**"]\n')
    assert c.include_private and c.include == ("a/**",) and config.parse(c.to_toml()) == c
    for bad in ("max_file_size = 0", "max_file_size = 200000000", "include = []", 'include = ["target/**"]', "nope = 1", "x ="):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    (tmp_path / config.NAMES[1]).write_text("pretty = false\n")
    assert not config.find(tmp_path).pretty and config.find(tmp_path / "none") == config.Config()
    for preset in config.PRESETS.values():
        config.Config().merged(preset).validate()


def test_command_line(spark, project, tmp_path, capsys):
    assert cli.main(["extract", project]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 6
    assert cli.main(["deps", project]) == 0 and "is_recursive" in capsys.readouterr().out
    assert cli.main(["metrics", project]) == 0 and "documentation_coverage" in capsys.readouterr().out
    for fmt in ("markdown", "graphql", "rag"):
        assert cli.main(["extract", project, "--format", fmt]) == 0 and capsys.readouterr().out
    file = tmp_path / "c.toml"
    assert cli.main(["config", "init", str(file), "--preset", "analysis"]) == 0 and config.load(file).include_private
    assert cli.main(["config", "validate", str(file)]) == 0

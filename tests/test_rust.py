import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlight.sources.rust import File, ParseError, line_counts, module_of


def one(source, **kw):
    (e,) = File(source, "crate", **kw).elements
    return e


def test_hierarchy():
    source = """
    pub mod shapes {
        pub struct Point { pub x: f64, pub y: f64 }
        impl Point {
            pub fn new(x: f64, y: f64) -> Self { Point { x, y } }
            pub fn norm(&self) -> f64 { (self.x * self.x + self.y * self.y).sqrt() }
        }
        pub fn origin() -> Point { Point::new(0.0, 0.0) }
    }
    pub fn outer() {}
    """
    by = {e["name"]: e for e in File(source, "crate").elements}
    module, block = by["shapes"], by["impl Point"]
    assert (module["parent_id"], module["nesting_level"], module["complexity"]) == (None, 0, 1)
    assert (by["outer"]["parent_id"], by["outer"]["nesting_level"]) == (None, 0)
    for name in ("Point", "impl Point", "origin"):
        assert (by[name]["parent_id"], by[name]["nesting_level"]) == (module["element_id"], 1)
    for name in ("new", "norm"):
        assert (by[name]["parent_id"], by[name]["nesting_level"]) == (block["element_id"], 2)
    assert by["origin"]["module_path"] == "crate::shapes" and by["origin"]["line_start"] == 8


@pytest.mark.parametrize(
    "body, want",
    [
        ("if a > 0 { if a > 9 { 1 } else { 2 } } else { 3 }", {"cyclomatic": 3, "cognitive": 5}),
        ("return 1; return 2; return 3;", {"cyclomatic": 1, "return_count": 3}),
        ("match a { 1 => 1, 2 => 2, _ => { 3 } }", {"cyclomatic": 4, "cognitive": 2, "nesting_depth": 3}),
        ("a && b || c", {"cyclomatic": 3, "cognitive": 0}),
        ("let x = f()?; for i in x { while i { break; } }", {"cyclomatic": 4, "cognitive": 2 + 2 + 3 + 4}),
        ("let c = || 1; let r = &&a;", {"cyclomatic": 1}),
        ("P { a: 1, b: Q { c: 2 } }", {"nesting_depth": 1}),
    ],
)
def test_function_metrics(body, want):
    e = one(f"pub fn f(a: i32) -> i32 {{ {body} }}")
    assert {k: e[k] for k in want} == want


def test_known_values():
    assert one("pub fn f(a: i32, b: i32, c: Map<i32, i32>, d: (u8, u8), e: [u8; 4], g: fn(i32, i32)) {}")["parameter_count"] == 6
    fib = one("pub fn fib(n: u64) -> u64 { if n < 2 { n } else { fib(n - 1) + fib(n - 2) } }")
    assert (fib["cyclomatic"], fib["parameter_count"]) == (2, 1) and fib["halstead_total2"] > 3
    e = one("pub enum E { A, B(i32), C { x: i32 }, D(String) }")
    assert (e["cyclomatic"], e["cognitive"]) == (4, 7)
    deep = one("pub fn d() { " + "if true { " * 20 + "} " * 20 + "}")
    assert deep["nesting_depth"] >= 20 and deep["cyclomatic"] > 20 and deep["complexity"] > 50


def test_visibility_docs_attributes_and_what_is_not_emitted():
    source = '''
    //! file
    /// One.
    /** Two. */
    #[test] #[cfg(feature = "x")]
    pub(crate) async unsafe fn a<T: Clone, const N: usize>() where T: Send {}
    fn hidden() {}
    pub const X: [u8; 2] = [1, 2]; pub static Y: &str = "{"; pub type Z = Vec<u8>;
    macro_rules! m { ($a:expr) => { $a } }
    pub trait Shape { fn area(&self) -> f64; type Unit; }
    impl Shape for X<'_> { fn area(&self) -> f64 { 1.0 } }
    '''
    f = File(source, "crate")
    assert [(e["element_type"], e["name"]) for e in f.elements] == [("Function", "a"), ("Trait", "Shape"), ("Impl", "Shape for X<'_>")]
    a = f.elements[0]
    assert (a["visibility"], a["visibility_scope"], a["doc_comments"], a["generic_params"]) == ("Restricted", "crate", ["One.", "Two."], ["T: Clone", "const N: usize"])
    assert a["attributes"] == ["#[test]", '#[cfg(feature="x")]']
    assert [e["name"] for e in File(source, "crate", include_private=True, include_docs=False).elements] == ["a", "hidden", "Shape", "Shape for X<'_>", "area"]


def test_references_and_imports():
    f = File("use a::b::{C as D, e}; use g::*; use h;\npub fn run(x: Thing) { go(x); x.step(); util::make::<u8>(1); say!(\"{}\", x); let v = count; }", "crate")
    assert [(i["module_path"], i["imported_items"], i["is_glob"], i["alias"]) for i in f.imports] == [("a::b", ["C"], False, "D"), ("a::b", ["e"], False, None), ("g", [], True, None), ("h", [], False, None)]
    kinds = {(r["reference_type"], r["reference_text"]) for r in f.references}
    assert {("FunctionCall", "go"), ("FunctionCall", "step"), ("MacroInvocation", "say"), ("TypeUsage", "Thing"), ("VariableAccess", "count")} <= kinds
    assert any(k == "FunctionCall" and t.startswith("util::make") for k, t in kinds)


@pytest.mark.parametrize("source", ["fn", "pub fn x( {", "struct {", "}", "pub enum E", 'fn f() { let s = "abc }', "this is no code", "impl {", "/* open", "mod m"])
def test_broken_sources(source):
    with pytest.raises(ParseError):
        File(source, "crate")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["if a { }", "while b { c(); }", "let d = 1;", "match e { 1 => 2, _ => 3 };", "for i in 0..3 { }", "return;", "x.y(1);", "loop { break; }"]), max_size=8))
def test_metric_identities(parts):
    e = one("pub fn f() { " + " ".join(parts) + " }")
    assert e["complexity"] == max(1, 2 * e["cyclomatic"] + e["cognitive"] + e["nesting_depth"] + e["return_count"])
    assert e["cyclomatic"] >= 1 and e["nesting_depth"] >= 1 and e["halstead_n1"] <= e["halstead_total1"] and e["halstead_n2"] <= e["halstead_total2"]
    assert e["cyclomatic"] == 1 + sum(2 if p.startswith("match") else p.split()[0] in ("if", "while", "for", "loop") for p in parts)


def test_lines_and_modules():
    assert line_counts("// a\n\nfn f() {}\n/* b */\n  // c") == (2, 2)
    assert (module_of("src/main.rs"), module_of("a/lib.rs"), module_of("src/deep/x.rs")) == ("crate", "crate", "crate::x")

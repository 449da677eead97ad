import random

from cairnlight.llm import line_dedup


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if text is None:
            out.append((i, None, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            if line.strip(" \t\r\f\v") and line in seen:
                gone += 1
            else:
                kept.append(line)
                seen.add(line)
        out.append((i, "\n".join(kept), gone))
    return out


def run(df, **kw):
    return sorted(((r["doc_id"], r["text"], r["gone"]) for r in line_dedup.dedup_lines(df, removed_col="gone", **kw).collect()), key=repr)


def test_against_brute_force(docs_of):
    rng = random.Random(1)
    lines = [f"line {k} " * rng.randint(1, 4) for k in range(60)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(0, 9)))) for i in range(80)]
    rows += [(None, "line 3 \nonly here"), (200, None), (201, ""), (202, "x" * 300_000 + "\nline 4 ")]
    assert run(docs_of(rows)) == sorted(brute(rows), key=repr)


def test_full_filter_changes_nothing(docs_of):
    rows = [(i, f"a{i % 7}\nb{i % 5}\nc{i}") for i in range(60)]
    assert run(docs_of(rows), max_filter_bytes=1) == run(docs_of(rows))


def test_repeated_rows_keep_first_occurrences_once(docs_of):
    got = run(docs_of([(1, "a\nb"), (1, "a\nb"), (2, "b\nc")]))
    assert got == sorted([(1, "a\nb", 0), (1, "", 2), (2, "c", 1)], key=repr)


def test_many_copies_of_rows(docs_of):
    rows = [(5, "a\nb\nb")] * 700 + [(None, "a\nc")] * 500 + [(1, "b\nd")]
    got = run(docs_of(rows))
    assert sorted(got, key=repr) == sorted([(1, "b\nd", 0), (5, "a", 2)] + [(5, "", 3)] * 699 + [(None, "c", 1)] + [(None, "", 2)] * 499, key=repr)


def test_clashing_line_keys_change_nothing(docs_of, monkeypatch):
    rows = [(i, f"a{i % 7}\nb{i % 5}\nc{i}") for i in range(60)]
    want = run(docs_of(rows))
    real = line_dedup.F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: real(*c) if "`text`" in str(c) or "text" in str(c[-1]) else line_dedup.F.pmod(real(*c), line_dedup.F.lit(2)))
    assert run(docs_of(rows)) == want


def test_documents_without_suspects_do_not_move(docs_of):
    df = docs_of([(i, f"only {i}\nhere {i}") for i in range(50)] + [(90, "both"), (91, "both")])
    out = line_dedup.dedup_lines(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.strip().startswith("Union")
    assert sorted(r["text"] for r in out.where("doc_id >= 90").collect()) == ["", "both"]


def test_nested_maps(spark):
    rows = [(1, "a\nb", [{"x": {"k": 1}}]), (1, "a\nb", [{"x": {"k": 1}}]), (2, "b\nc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<map<string,map<string,int>>>")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(df).collect()) == ["", "a\nb", "c"]


def test_filters_in_several_flushes(docs_of, monkeypatch):
    rows = [(i, f"a{i % 7}\nb{i % 5}\nc{i}") for i in range(60)]
    want = run(docs_of(rows))
    monkeypatch.setattr(line_dedup, "FLUSH_HASHES", 5)
    assert run(docs_of(rows)) == want


def test_empty_table_and_columns(docs_of):
    df = docs_of([])
    out = line_dedup.dedup_lines(df)
    assert out.count() == 0 and out.columns == df.columns

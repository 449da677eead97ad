import random
import textwrap

import numpy as np

from cairnlight.llm import license_scan as ls
from cairnlight.llm.license_texts import PASSAGES

WORDS = "ander seloit mira under the of and doku restal this version was general public free".split()


def background(n=400, seed=2):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(("", "", "ta", "x")) for _ in range(rng.randint(3, 40))) for _ in range(n)]


def test_held_out_quality():
    _, found = ls.fit(background())
    assert found["accuracy"] > 0.94 and found["precision"] > 0.97 and found["recall"] > 0.9


def test_scan(docs_of):
    known = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "All rights reserved.": "all-rights-reserved", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0",
    }
    lines = background(300, 9)
    rows = [(i, f"{lines[i]}\n{t}\n\n{lines[i + 50]}") for i, t in enumerate(known)]
    clean = [(100 + i, "\n".join(lines[i : i + 6])) for i in range(100, 160)]
    odd = [(900, None), (901, ""), (902, "\n \n"), (None, "Released under the MIT License."), (903, "word " * 100_000), (904, "Mit."), (0, rows[0][1]), (905, "//\n# *\n")]
    out = ls.scan(docs_of(rows + clean + odd)).collect()
    sure = [r for r in out if r["confirmed"]]
    assert {(r["doc_id"], r["paragraph"], r["line"], r["family"]) for r in sure} == {(i, 1, 2, f) for i, f in enumerate(known.values())} | {(None, 1, 1, "mit")}
    assert sum(r["doc_id"] == 0 for r in sure) == 2
    assert all(0 <= r["similarity"] <= 1 and 0 < r["probability"] <= 1 for r in out)
    assert ls.scan(docs_of([])).count() == 0


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_whole_licence_texts_as_files_have_them(docs_of):
    """Paragraphs wrapped, commented or in one line among other words, all lines and windows included."""
    mit, own = PASSAGES["mit"], background(40, 4)
    texts = {
        1: wrapped(mit[0], 72) + "\n\n" + wrapped(mit[2], 72), 2: wrapped(mit[0], 60, " * "), 3: "\n\n".join(wrapped(t, 76, "// ") for t in PASSAGES["apache-2.0"][:2]),
        4: wrapped(PASSAGES["gpl-3.0"][0], 72, "# "), 5: " ".join(own[:6]) + " " + mit[0] + " " + " ".join(own[6:12]), 6: wrapped(" ".join(PASSAGES["bsd"][:4]), 70, "-- "),
        7: "\n".join([*own[:3], wrapped(PASSAGES["mpl-2.0"][0], 80), *own[3:6]]), 8: wrapped(PASSAGES["isc"][1], 72, ";; "), 9: "\n\n".join(own),
    }
    out = ls.scan(docs_of(list(texts.items()))).where("confirmed").collect()
    got = {(r["doc_id"], r["family"]) for r in out}
    assert got >= {(1, "mit"), (2, "mit"), (3, "apache-2.0"), (4, "gpl-3.0"), (5, "mit"), (6, "bsd"), (7, "mpl-2.0"), (8, "isc")}
    assert not any(i == 9 for i, _ in got) and {f for i, f in got if i in (1, 2, 5)} == {"mit"}
    assert sum(r["doc_id"] == 1 for r in out) == 2


#: Written for this test, in other words than the training texts.
HELD_OUT = {
    "mit": ["foo is MIT licensed.", "Code in this folder is under the MIT license, see LICENSE.", "MIT License. Copyright 2021 Jane Doe", "Distributed under the terms of the MIT license.", "license = \"MIT License\""],
    "apache-2.0": ["All our code is Apache 2.0 licensed, Apache License Version 2.0 that is.", "Available under the Apache License, Version 2.0, at your option.", "Apache License Version 2.0, January 2004", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-3.0": ["Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "This package is GNU General Public License v3.0 or later.", "Released as free software under GPL version 3 or later"],
    "gpl-2.0": ["This file is licensed under the GNU General Public License version 2 only, as is the kernel.", "The driver is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "bsd": ["Distributed under the BSD 3-Clause License, see COPYING.", "Redistribution and use in source and binary forms, with or without modification, are permitted if these conditions hold:"],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-sa": ["Our documentation is available under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["The data set is in the public domain, CC0 1.0 Universal Public Domain Dedication."],
    "all-rights-reserved": ["(c) 2011-2015 Small Press Ltd. All rights reserved."],
    "unknown": [
        "The club licensed its name to a brewery.", "You must give the book back by Friday.", "Version 3 of the plan was published by the foundation last week.", "We reserve the right to change prices.", "The public library is free for all.", "Apache helicopters were seen near the border.",
        "The MIT campus lies by the river.", "He attributes his success to his parents and to common sense.", "Redistribution of wealth was debated in parliament.", "Permission slips are due, signed by a parent, before the trip to the museum.", "The software was slow and came without a manual.", "Any person in the building must leave at once.",
        "Copies of the report can be had at the front desk, free of charge, subject to stock.", "Under the terms of the peace, both armies went home.",
    ],
}


def test_held_out_texts_of_another_hand(docs_of):
    model = ls.fit(background())[0]
    rows = [(f, t) for f, texts in HELD_OUT.items() for t in texts]
    out = ls.scan(docs_of([(i, t) for i, (_, t) in enumerate(rows)]), model=model).collect()
    said = {r["doc_id"]: r["family"] for r in out}
    licences = [i for i, (f, _) in enumerate(rows) if f != ls.UNKNOWN]
    assert sum(said.get(i) == rows[i][0] for i in licences) >= 0.85 * len(licences)
    assert sum(i not in said for i in range(len(rows)) if i not in licences) >= 0.9 * (len(rows) - len(licences))
    assert not any(r["confirmed"] for r in out if rows[r["doc_id"]][0] == ls.UNKNOWN)


def brute_scan(model, text, confirm_at):
    """Rows of one text, by loops and dictionaries."""
    own = {f: set() for f in model.classes}
    for f, texts in ls.templates().items():
        for t in texts:
            w = ls.tokens(t)
            own[f] |= {(a,) for a in w} | set(zip(w, w[1:]))
    names = {v: k for k, v in model.words.items()}
    row_of = {(w,): k for w, k in model.words.items()} | {(names[c // len(names)], names[c % len(names)]): k + len(names) for k, c in enumerate(model.pairs.tolist())}

    def part(words):
        grams = set((a,) for a in words) | set(zip(words, words[1:]))
        total = 2 * len(words) - 1
        repeats = sum(g in row_of for g in [(a,) for a in words] + list(zip(words, words[1:]))) - sum(g in row_of for g in grams)
        n = max(total - repeats, 1)
        z = (sum((model.weights[row_of[g]].astype(float) for g in grams if g in row_of), np.zeros(len(model.classes))) / np.sqrt(n) + model.weights[-1]) / model.temperature
        top = int(z.argmax())
        shared = sum(g in own[model.classes[top]] for g in grams if g in row_of)
        return model.classes[top], 1 / np.exp(z - z.max()).sum(), (shared if shared >= ls.LEAST_SHARED else 0) / n

    out, paragraph = [], []
    for number, line in enumerate([*text.split("\n"), ""], 1):
        words = ls.tokens(line)
        if words:
            paragraph.append((number, words))
            continue
        flat = [(n, w) for n, ws in paragraph for w in ws]
        parts = [flat] if flat else []
        if flat:
            family, chance, similar = part([w for _, w in flat])
            if not (family != ls.UNKNOWN and chance >= model.threshold and similar >= confirm_at):
                parts += [[(n, w) for w in ws] for n, ws in paragraph] if len(paragraph) > 1 else []
                if len(flat) > ls.WINDOW:
                    for at in (0, -(ls.WINDOW // 2)):
                        parts += [flat[max(k, 0) : k + ls.WINDOW] for k in range(at, len(flat), ls.WINDOW) if k + ls.WINDOW > 0]
        best = {}
        for p in parts:
            family, chance, similar = part([w for _, w in p])
            if family != ls.UNKNOWN and chance >= model.threshold:
                best.setdefault(family, []).append((-round(similar, 6), -round(chance, 6), p[0][0]))
        out += [(flat[0][0], min(v)[2], f, -min(v)[1], -min(v)[0]) for f, v in best.items()]
        paragraph = []
    return out


def test_scan_against_brute_force(docs_of):
    rng, model = random.Random(21), ls.fit(background())[0]
    pool = [t for texts in ls.templates().values() for t in texts]
    rows = []
    for i in range(60):
        blocks = []
        for _ in range(rng.randint(1, 5)):
            words = [w for t in rng.sample(pool, rng.randint(0, 2)) for w in t.split()]
            words += " ".join(rng.sample(background(50, i), rng.randint(0, 5))).split()
            at = rng.randrange(len(words) + 1)
            blocks.append(wrapped(" ".join(words[at:] + words[:at]), rng.choice((40, 72, 5000)), rng.choice(("", "# ", "/* "))))
        rows.append((i, rng.choice(("\n\n", "\n", "\n #\n")).join(blocks)))
    got = sorted((r["doc_id"], r["paragraph"], r["line"], r["family"], r["probability"], r["similarity"]) for r in ls.scan(docs_of(rows), model=model).collect())
    want = sorted((i, *x) for i, t in rows for x in brute_scan(model, t, ls.CONFIRM_AT))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) > 80
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-4)


def test_similarity_is_the_share_of_template_n_grams():
    model, _ = ls.fit(background())
    text = ls.tokens("Released under the MIT License. gorbl")
    ids = np.array([model.words.get(w, -1) for w in text])
    top, _, similar = model.scores(ids, np.zeros(len(ids), np.int64), 1)
    grams = [(a,) for a in text] + list(zip(text, text[1:]))
    own = {g for t in ls.templates()["mit"] for w in [ls.tokens(t)] for g in [(a,) for a in w] + list(zip(w, w[1:]))}
    assert model.classes[top[0]] == "mit" and np.isclose(similar[0], sum(g in own for g in grams) / len(grams))

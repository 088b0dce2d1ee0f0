import os
import random
import re
import textwrap
from collections import Counter

import pytest
from compare import assert_same

from larkspur import llm
from larkspur.llm import license_scan, mixing, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(llm.QUERIES[name](spark, SF), llm.ORACLES[name], SF)


TEXTS = [None, "", "   \n", "a b c d e " * 6, "one two three four five six seven eight nine ten", "x\ny\nx\nx\nz", "### $$ % a|b", "w" * 5000, "a\x0bb\x0cc\rd", "r s t u v w x y z q r s t u v w"]


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    hit = {j for i, x in enumerate(win) if c[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_measurements(frame):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)]
    led = quality_rules.apply_policy(quality_rules.ledger(frame(rows)))
    for r in led.collect():
        n, chars, symbols, dups, repeats = measured(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation_come_from_bits(frame):
    led = quality_rules.ledger(frame([(i, t) for i, t in enumerate(TEXTS)]))
    bits = [r.failed_bits for r in led.collect()]
    for policy, m in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(led, policy).where("kept").count()
        assert kept == sum((b & (m | quality_rules.mask(*quality_rules.BASE))) == 0 for b in bits)
        for r in quality_rules.ablation(led, policy).collect():
            one = 1 << quality_rules.BIT[r.rule]
            assert (r.n_failed, r.n_only, r.n_docs) == (sum(b & one > 0 for b in bits), sum(b & m == one for b in bits), len(bits))


def test_quality_filter_keeps_columns(frame):
    docs = frame([(1, "one two three four five six seven eight nine ten eleven"), (2, "no"), (None, None)])
    out = quality_rules.keep_documents(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_rules_on_empty(frame):
    led = quality_rules.ledger(frame([]))
    assert led.count() == 0 and all(r.n_failed == 0 for r in quality_rules.ablation(led).collect())


MIT = "\n".join(license_scan.TEXTS["MIT"])
BSD3 = "\n".join(license_scan.TEXTS["BSD-3-Clause"])


def test_licenses(frame):
    rows = [
        (1, "Prose. Released under the MIT License."), (2, MIT), (3, "x\n" + BSD3 + "\ny"), (4, "\n".join(reversed(license_scan.TEXTS["BSD-2-Clause"]))),
        (5, None), (6, ""), (7, "LICENSED UNDER THE   APACHE LICENSE, VERSION 2.0."), (8, "a license to kill. permission granted"), (None, "License: MIT\nLicensed under CC BY-NC 4.0."), (9, MIT),
    ]
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(frame(rows)).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["BSD-3-Clause"], 4: [], 5: [], 6: [], 7: ["Apache-2.0"], 8: [], None: ["CC-BY-NC-4.0", "MIT"], 9: ["MIT"]}


def test_wrapped_licenses(frame):
    wrap = lambda s, lead="", first="": "\n".join(textwrap.wrap(s, 72, initial_indent=lead + first, subsequent_indent=lead + " " * len(first)))
    t = license_scan.TEXTS
    bsd = lambda name, lead="": f"\n{lead}".join([wrap(t[name][0], lead)] + [wrap(x, lead, f"{i}. ").removeprefix(lead) for i, x in enumerate(t[name][1:], 1)])
    rows = [
        (1, "MIT License\n\nCopyright (c) 2026 x\n\n" + "\n\n".join(map(wrap, t["MIT"]))), (2, bsd("BSD-3-Clause")), (3, "/*\n * Copyright x\n *\n" + bsd("BSD-2-Clause", " * ") + "\n */"),
        (4, wrap(t["GPL-2.0-or-later"][0], "# ")), (5, wrap(t["GPL-3.0-or-later"][0], "// ").replace("\n", "\r\n")), (6, wrap(t["ISC"][0])), (7, "Distributed under\nthe MIT."), (8, "Licensed under the\n\nMIT License."), (9, "License: MIT\nother words\x01here"),
    ]
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(frame(rows)).collect()}
    assert got == {1: ["MIT"], 2: ["BSD-3-Clause"], 3: ["BSD-2-Clause"], 4: ["GPL-2.0-or-later"], 5: ["GPL-3.0-or-later"], 6: ["ISC"], 7: ["MIT"], 8: [], 9: ["MIT"]}


def by_sentences(text):
    """Licences by the rules, stated in Python: lines and joined paragraphs, known sentences, sequences of identifiers."""
    text = re.sub(license_scan.WRAP, "\x01", (text or "").lower().replace("\x01", "\x02"))
    ids = []
    for part in re.split(license_scan.BREAK_JOINED, text):
        lines = [x for x in map(license_scan.normal, part.split("\x01")) if x]
        joined = [" ".join(lines[i:]) for i in range(len(lines) - 1)]
        ids += [license_scan.KNOWN.index(x) + 1 for x in lines + joined if x in license_scan.KNOWN]
        ids += license_scan.notices_of(" ".join(lines)) if " ".join(lines) not in license_scan.KNOWN else []
    said = "," + ",".join(map(str, ids)) + ","
    found = {name for name, seq in license_scan.RULES if "," + ",".join(map(str, seq)) + "," in said}
    return ids, sorted(found - {p for p, w in license_scan.INSIDE.items() if w in found})


def hostile():
    rng = random.Random(12)
    names = [f.format(the=the, name=n) for ns in license_scan.NAMES.values() for n in ns for f in license_scan.FRAMES for the in ("the ", "")]
    texts = [s for t in license_scan.TEXTS.values() for s in t] + [s for _, t in license_scan.FURTHER for s in t] + list(license_scan.WITH_TEXTS)
    rows = ["Distributed under\tMIT.", "Released under: the ISC.", "(released UNDER) the -- isc licence? Licensed under\u00a0the MIT", "wonderunder the MIT", "Available under*the*ISC!", "License:MIT", "understand", "license", None, ""]
    for _ in range(150):
        said = rng.choice(names) if rng.random() < 0.6 else rng.choice(texts)
        mark = rng.choice([" ", "\t", ": ", " - ", "\u3000", "_", "\r", "\x0b", ",, "])
        words = said.split(" ")
        said = " ".join(words) if rng.random() < 0.3 else "".join(w + (mark if rng.random() < 0.4 else " ") for w in words)
        rows.append(rng.choice(["", "Prose! ", "x? ", "(c) ", "\t"]) + (said.upper() if rng.random() < 0.2 else said) + rng.choice(["", ".", ". More.", "! ", "?"]))
    return list(enumerate(rows))


def test_license_scan_on_hostile_separators(spark, frame, tmp_path):
    """One line a text: the operator, its SQL and the rules agree."""
    rows = hostile()
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(llm.QUERIES["op5_license_scan"](spark, str(tmp_path)), llm.ORACLES["op5_license_scan"], str(tmp_path))
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in license_scan.scan(frame(rows)).collect()}
    assert got == {d: by_sentences(t) for d, t in rows}
    assert got[0][1] == ["MIT"] and got[1][1] == ["ISC"] and got[4][1] == ["ISC"] and sum(bool(x) for _, x in got.values()) > 80


def test_license_scan_of_wrapped_texts_against_rules(frame):
    rng = random.Random(13)
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            said = rng.choice([" ".join(rng.choice(list(license_scan.TEXTS.values()))), *license_scan.WITH_TEXTS, *(x for _, t in license_scan.FURTHER for x in t), "Released under the MIT License."])
            lead = rng.choice(["", "# ", " * ", "// ", "; "])
            parts.append("\n".join(textwrap.wrap(said, rng.choice([40, 72, 200]), initial_indent=lead, subsequent_indent=lead)))
        rows.append((i, rng.choice(["\n\n", "\n", "\r\n \n"]).join(parts)))
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in license_scan.scan(frame(rows)).collect()}
    assert got == {d: by_sentences(t) for d, t in rows} and sum(bool(x) for _, x in got.values()) > 50


def test_licenses_of_real_files(frame):
    """A licence text right after its title or notice, other comment leaders, SPDX expressions, and names inside longer sentences."""
    mit = "\n".join(textwrap.wrap(license_scan.TEXTS["MIT"][0], 76)) + "\n\n" + "\n".join(textwrap.wrap(license_scan.TEXTS["MIT"][1], 76))
    cases = {
        "MIT License\n" + mit: ["MIT"], "Copyright (c) 2020 Foo Bar\n" + mit: ["MIT"], "Title\nCopyright 2020 Foo Bar\nAll rights reserved\n" + mit: ["MIT"],
        "rem " + mit.replace("\n", "\nrem "): ["MIT"], "dnl " + mit.replace("\n", "\ndnl "): ["MIT"], "' " + mit.replace("\n", "\n' "): ["MIT"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"], "// SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0-only"], "# SPDX-License-Identifier: (LGPL-2.1-or-later AND MIT)": ["LGPL-2.1-or-later", "MIT"],
        "This code is released under the MIT license": ["MIT"], "Licensed under the MIT license, see LICENSE for details.": ["MIT"], "Licensed under MIT or Apache-2.0": ["Apache-2.0", "MIT"],
        "The engine is made available under the terms of the Mozilla Public\nLicense 2.0 and its tools are distributed under the ISC license.": ["ISC", "MPL-2.0"],
        "They worked under the mitigation plan. Licensed underneath MIT.": [], "is licensed under mitigated terms": [], "Licensed under\n\nMIT": [],
    }
    got = {r.doc_id: list(r.licenses) for r in license_scan.scan(frame(list(enumerate(cases)))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_sql_states_wrapped_texts(spark, frame, tmp_path):
    rng = random.Random(14)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            said = rng.choice([" ".join(rng.choice(list(license_scan.TEXTS.values()))), *license_scan.WITH_TEXTS, "Released under the MIT License.", "Both are released under the MIT license or Apache-2.0, at will", "prose of no meaning.", "SPDX-License-Identifier: MIT AND ISC", "1. item", "(a) item", ""])
            lead = rng.choice(["", "# ", " * ", "// ", "; ", "rem ", "' ", "-- ", "- "])
            parts.append("\n".join(textwrap.wrap(said, rng.choice([30, 72, 200]), initial_indent=lead, subsequent_indent=lead)))
        rows.append((i, rng.choice(["\n\n", "\n", "\r\n \n", "\n \t\n", "\n\x01"]).join(parts) + rng.choice(["", "\n", "\n ", " "])))
    frame([*rows, (None, None), (900, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(llm.QUERIES["op5_license_scan"](spark, str(tmp_path)), llm.ORACLES["op5_license_scan"], str(tmp_path))
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in license_scan.scan(frame(rows)).collect()}
    assert got == {d: by_sentences(t) for d, t in rows} and sum(bool(x) for _, x in got.values()) > 50


def test_license_scan_of_nothing(frame):
    assert license_scan.scan(frame([])).count() == 0


def fill(sizes, cap=3):
    """Water-filling by rounds: targets by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_water_filled_targets(frame):
    sources = [["a", "b", "b", "c", None, "z", "é", "b"][i % 8] if i % 5 else "b" for i in range(90)]
    rows = [(i, " ".join(["w"] * ((i * 7) % 40))) for i in range(90)]
    sizes = Counter()
    for s, (_, t) in zip(sources, rows):
        sizes[s] += len(t.split())
    plan = mixing.plan_mix(frame(rows, sources)).collect()
    want = fill(sizes)
    taken = Counter()
    for r in plan:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = {r.doc_id: r.taken for r in mixing.plan_mix(frame(rows, sources).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in plan}
    words = Counter()
    out = mixing.mix_documents(frame(rows, sources))
    for r in out.collect():
        words[r.source] += len(r.text.split())
    assert out.columns == frame(rows, sources).columns and words == {s: n for s, n in taken.items() if n}


def test_mix_edges(frame):
    assert mixing.plan_mix(frame([])).count() == 0
    rows = mixing.plan_mix(frame([(1, None), (2, ""), (None, " ")], ["a", None, "a"])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    tied = mixing.plan_mix(frame([(1, "a b"), (1, "a b"), (1, "c")], ["a", "a", None])).collect()
    assert sum(r.taken for r in tied) == 5


def test_mix_keeps_rows_with_null_and_repeated_ids(frame):
    """Ids (1, 1, null, 2, null): each row is taken as its plan says, however its id repeats."""
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (2, "f g h i"), (None, "j")]
    out = [(r.doc_id, r.text) for r in mixing.mix_documents(frame(rows, ["x", "x", "x", "x", "x"])).collect()]
    assert sorted(out, key=repr) == sorted(rows, key=repr)  # one source takes all its words once
    rows = [(7, f"w{i} " * (i % 5 + 1)) for i in range(30)] + [(None, f"n{i}") for i in range(10)]
    sources = [["a", "b"][i % 2] for i in range(40)]
    plan = mixing.plan_mix(frame(rows, sources)).collect()
    out = mixing.mix_documents(frame(rows, sources)).collect()
    assert len(plan) == 40 and sum(len(r.text.split()) for r in out) == sum(r.taken for r in plan)
    assert Counter(r.doc_id for r in out if r.doc_id is None)[None] >= 5


def test_cut_repetitions_keep_white_space(frame):
    text = " one\ttwo\n\nthree  four five six seven eight "
    rows = [(1, text), (2, " ".join("abcdefgh"))]
    out = mixing.mix_documents(frame(rows, ["a", "b"])).where("doc_id = 1").collect()
    plan = {r.doc_id: r for r in mixing.plan_mix(frame(rows, ["a", "b"])).collect()}
    cut = [r for r in out if r.text != text]
    assert plan[1].taken % 8 and len(cut) == 1
    assert text.startswith(cut[0].text) and len(cut[0].text.split()) == plan[1].taken % 8 and cut[0].n_chars == len(cut[0].text)

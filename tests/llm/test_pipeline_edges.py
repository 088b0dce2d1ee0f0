"""The whole pipeline on small tables with nulls, repeated rows and ids, extreme ids, empty and long texts, or no rows."""

import random
from collections import Counter

import pytest
from test_exact_dedup import want
from test_near_dedup import classes
from test_rules_licenses_mixing import fill

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(21)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randrange(20, 90)), "abc"[i % 3]) for i in range(40)]
    base = rows[0][1]
    rows += [(100 + k, base.replace("word", "word", 1) + f" tail{k}", "a") for k in range(3)]  # near copies
    rows += [(7, rows[7][1], "b"), (7, rows[7][1], "b"), (200, rows[7][1].replace(" ", "\n"), None)]  # repeated rows, equal after white space
    rows += [(None, prose(30), None), (None, prose(40), "c"), (None, None, None), (300, None, "a"), (301, "", "a")]
    rows += [(2**63 - 1, prose(50), "a"), (-(2**63), prose(50), "b"), (302, " \t ".join(rng.choice(words) for _ in range(6000)), "c")]
    return [(d, t, "en" if i % 5 else None, s, None if t is None else len(t)) for i, (d, t, s) in enumerate(rows)]


def test_edges_end_to_end(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, seen[-1], str(tmp_path))
        assert out.columns == docs.columns
        seen.append(out.cache())
    data = [[(r.doc_id, r.text) for r in d.collect()] for d in seen]
    # quality: all but the texts without words stay, whatever their ids
    assert Counter(data[1]) == Counter((d, t) for d, t, *_ in rows if t and t.strip())
    # exact: one row of each text, null ids too
    groups = {k for _, k, _, _ in want(data[1])}
    assert len(data[2]) == len({" ".join(t.split()) for _, t in data[1]}) and {d for d, _ in data[2]} <= groups | {None}
    # near: one of each class; null ids stay
    top = classes([x for x in data[2] if x[0] is not None])
    assert sorted(d for d, _ in data[3] if d is not None) == sorted(set(top.values()))
    assert sum(d is None for d, _ in data[3]) == sum(d is None for d, _ in data[2]) == 2
    # mix: every source's words come to its target, counted row by row
    sizes, taken = Counter(), Counter()
    for r in seen[3].collect():
        sizes[r.source] += len(r.text.split())
    for r in seen[4].collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - w) <= 1 for s, w in fill(sizes).items())
    # tokens: each row of the mix, repetitions by samples of their own
    got = p.STAGES[-1][1](spark, seen[4], str(tmp_path)).collect()
    assert sum(r.sample == 1 for r in got) == len(data[4]) and all(r.round_trip for r in got)
    assert Counter(r.doc_id for r in got if r.sample == 1) == Counter(d for d, _ in data[4])
    long_texts = [tuple(r.ids) for r in got if r.doc_id is not None and r.n_tokens > 60]
    assert len(set(long_texts)) == len(long_texts)
    whole = p.run(spark, str(tmp_path))
    assert sorted((r.doc_id or 0, r.repetition, r.sample, tuple(r.ids)) for r in whole.collect()) == sorted((r.doc_id or 0, r.repetition, r.sample, tuple(r.ids)) for r in got)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", [None, "", "one two"])
def test_pipeline_of_one_row_that_goes(spark, tmp_path, text):
    spark.createDataFrame([(None, text, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0

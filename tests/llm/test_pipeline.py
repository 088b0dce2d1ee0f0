import os

import pytest
from test_exact_dedup import want
from test_near_dedup import classes

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, seen[-1], SF).cache()
        assert out.columns == names
        seen.append(out)
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in seen]
    assert 0 < len(rows[1]) < len(rows[0])
    assert sorted(rows[2]) == sorted((d, t) for d, t in rows[1] if d in {k for _, k, _, _ in want(rows[1])})
    top = classes(rows[2])
    assert sorted(d for d, _ in rows[3]) == sorted(set(top.values()))
    sizes = dict(rows[3])
    assert {d for d, _ in rows[4]} <= set(sizes)
    total = sum(len(t.split()) for t in sizes.values())
    assert abs(sum(len(t.split()) for _, t in rows[4]) - total) <= 20
    encoded = p.STAGES[-1][1](spark, seen[-1], SF)
    assert encoded.where("sample = 1").count() == len(rows[4]) and encoded.where("NOT round_trip").count() == 0

"""Rows that share an id with different texts, and columns named as the operators' own or with dots, in every stage."""

from collections import Counter

import pytest

import corpus_pipeline as p
from larkspur.llm import exact_dedup, near_dedup, secret_scan
from larkspur.llm import sentencepiece_sampling as sp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, digest int, class_id int, kept string, _same int, row int, size int, rep long, gid long, uid long"
A, B = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1, 2, "y", 3, 4, 5, 6, 7, 8) for d, t in rows], SCHEMA).repartition(2)


def test_a_text_whose_id_another_row_shares_stays(spark):
    rows = [(1, A), (2, A), (5, B), (5, A), (None, A), (8, B + " more"), (9, None)]
    kept = near_dedup.keep_one(table(spark, rows))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, A), (5, B), (None, A), (9, None)])


@pytest.mark.parametrize("stage", [near_dedup.keep_one, exact_dedup.keep_first, secret_scan.redact])
def test_columns_stay_as_they_were(spark, stage):
    docs = table(spark, [(1, A), (2, B), (3, None)])
    out = stage(docs)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_repetitions_take_any_columns(spark):
    docs = table(spark, [(1, A), (1, A), (2, B)])
    out = sp.repetitions(docs)
    assert out.columns == [*docs.columns, "repetition"]
    assert sorted((r.doc_id, r.repetition, r["_same"], r["a.b"]) for r in out.collect()) == [(1, 0, 3, "x"), (1, 1, 3, "x"), (2, 0, 3, "x")]
    with pytest.raises(ValueError, match="already"):
        sp.repetitions(out)


def test_pipeline_loses_no_text(spark, tmp_path):
    rows = [(1, A), (2, A), (5, B), (5, A), (5, B + " and a few words"), (6, " ".join(f"gamma{i}" for i in range(30)))]
    docs = table(spark, rows)
    for _, stage in p.STAGES[:3]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
    left = docs.collect()
    assert {r.text.split()[0] for r in left} == {"alpha0", "beta0", "gamma0"}
    mixed = p.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    encoded = p.encode(spark, mixed, str(tmp_path)).collect()
    assert all(r.round_trip for r in encoded) and {r.doc_id for r in encoded} == {r.doc_id for r in mixed.collect()}

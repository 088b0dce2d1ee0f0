import hashlib
import random
import re
from collections import defaultdict

from larkspur.llm import exact_dedup as x


def want(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (d, _), t in zip(rows, norm):
        groups[t].append(d)
    out = []
    for (d, _), t in zip(rows, norm):
        ids = [i for i in groups[t] if i is not None]
        out.append((d, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


ROWS = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (3, None), (4, ""), (None, "a b"), (7, " "), (8, "é\x0b\x0cé" * 5000), (1, "é é" * 5000), (6, "only")]


def test_equal_after_white_space(frame):
    df = x.exact_groups(frame(ROWS))
    assert got(df) == want(ROWS)
    kept = [r.doc_id for r in df.where("kept").collect()]
    assert sorted(kept) == sorted({r[1] for r in want(ROWS)})


def test_repeated_rows_keep_exactly_one(frame):
    df = x.exact_groups(frame([(1, "t")] * 5 + [(2, "t")]))
    assert sum(r.kept for r in df.collect()) == 1


def test_small_tables_force_recursion_and_flushes(frame):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(60)} " + "w" * rng.randrange(200)) for i in range(400)] + [(1000 + i, "hot " * 40) for i in range(300)]
    assert got(x.exact_groups(frame(rows), table_bytes=600)) == want(rows)


def test_keep_first_keeps_columns(frame):
    docs = frame(ROWS)
    out = x.keep_first(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} <= {(d, t) for d, t in ROWS}
    assert out.count() == len({t for *_, t in want(ROWS)})


def test_empty(frame):
    assert x.exact_groups(frame([])).count() == 0
    assert x.keep_first(frame([])).count() == 0


def test_table_compares_contents():
    t = x.ContentTable()
    same = b"\0" * 32  # one digest for all: only contents tell them apart
    assert [t.entry(c, same) for c in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    for i in range(3000):
        assert t.entry(str(i).encode(), hashlib.sha256(str(i).encode()).digest()) == i + 3
    assert t.entry(b"17", hashlib.sha256(b"17").digest()) == 20


def test_normalised():
    assert x.normalised(b"\t a \r\n\n b" + b" " * 100 + b"c ") == b" a b c "

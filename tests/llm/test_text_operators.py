import hashlib
import math
import random
import re
import subprocess
import sys
import time

import numpy as np
import pytest

from larkspur.llm import chat_format as chat
from larkspur.llm import quality_classifier as clf
from larkspur.llm import secret_scan as secrets
from larkspur.llm import sentencepiece_sampling as sp

# --- SentencePiece


@pytest.fixture(scope="module")
def v():
    return sp.vocabulary(sp.default_model(), 1.0)


def segmentations(v, text):
    """Log-probabilities of all segmentations of a short text."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    t = "▁" + text.replace(" ", "▁")

    def rec(i):
        if i == len(t):
            yield ()
        for size in range(1, 17):
            if i + size <= len(t) and (j := p.piece_to_id(t[i : i + size])) != p.unk_id():
                yield from ((j, *rest) for rest in rec(i + size))

    seg = {s: float(sum(v.log_weight[list(s)])) for s in rec(0)}
    z = math.log(sum(map(math.exp, seg.values())))
    return {s: w - z for s, w in seg.items()}


def rows(v, ids, texts, k, seed=1):
    return [r for b in sp.encode_chunk(v, ids, texts, k, seed) for r in b.to_pylist()]


def test_all_segmentations_come_once_in_order_of_arrival(v):
    want = segmentations(v, "the cat")
    got = rows(v, [1], ["the cat"], 500)
    assert {tuple(r["ids"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["log_prob"] - want[tuple(r["ids"])]) < 1e-9 and r["log_inclusion"] == 0 for r in got)
    order = [r["perturbed"] for r in got]
    assert order == sorted(order, reverse=True)


def test_first_and_second_have_the_right_frequencies(v):
    p = {s: math.exp(x) for s, x in segmentations(v, "the").items()}
    n = 6000
    got = rows(v, list(range(n)), ["the"] * n, 2)
    for s in sorted(p, key=p.get)[-2:]:
        first = sum(tuple(r["ids"]) == s for r in got if r["sample"] == 1) / n
        second = sum(tuple(r["ids"]) == s for r in got if r["sample"] == 2) / n
        assert abs(first - p[s]) < 0.03
        assert abs(second - sum(q * p[s] / (1 - q) for o, q in p.items() if o != s)) < 0.03


def test_inclusion_scores_estimate_totals(v):
    """Horvitz-Thompson weights add up to one on average."""
    n = 3000
    got = rows(v, list(range(n)), ["of the"] * n, 2)
    assert abs(sum(math.exp(r["log_prob"] - r["log_inclusion"]) for r in got) / n - 1) < 0.05


def test_round_trips_and_distinct_samples(v):
    texts = ["", " ", "▁ x", "日本\n\tü  ", "a" * 3000, "\n" * 400, "plain words in a row " * 50, "🙂" * 100 + "z", "\u0000\u007f"]
    got = rows(v, [None, *range(8)], texts, 3)
    assert all(r["round_trip"] for r in got)
    for d in range(8):
        ids = [tuple(r["ids"]) for r in got if r["doc_id"] == d]
        assert len(ids) == len(set(ids)) >= 1


def test_batches_do_not_matter(v):
    texts = [f"text number {i} of the batch" for i in range(20)]
    whole = rows(v, list(range(20)), texts, 2)
    alone = [r for i in range(20) for r in rows(v, [i], [texts[i]], 2)]
    assert sorted(whole, key=repr) == sorted(alone, key=repr)


def test_ids_at_both_ends_and_null_have_keys_of_their_own(v):
    ids = [None, -1, 0, 2**63 - 1, -(2**63)]
    keys = sp.row_keys(ids, 1)
    assert len(set(keys.tolist())) == 5
    text = "one and the same text for each of these rows"
    got = rows(v, ids, [text] * 5, 1)
    assert len({tuple(r["ids"]) for r in got}) == 5 and all(r["round_trip"] for r in got)
    again = sp.row_keys([7, 7, 7], 1, [0, 1, 2])
    assert len(set(again.tolist())) == 3 and again[0] == sp.row_keys([7], 1)[0]


def test_repetitions_are_sampled_anew(frame):
    text = "a text that the mix takes three times over"
    docs = frame([(1, text)] * 3 + [(2, text), (None, None), (None, None), (3, "")])
    numbered = sp.repetitions(docs)
    assert numbered.columns == [*docs.columns, "repetition"]
    assert sorted((r.doc_id or 0, r.repetition) for r in numbered.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    got = sp.sample_encode(numbered, repetition_col="repetition").where("doc_id IN (1, 2)").collect()
    assert len({tuple(r.ids) for r in got}) >= 7 and all(r.round_trip for r in got)
    assert sp.sample_encode(sp.repetitions(frame([])), repetition_col="repetition").count() == 0


def test_library_decodes_the_same(v):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    for r in rows(v, [1, 2], ["Hello  world, ñandú\nzwei", "x 日 y"], 2):
        assert p.decode(r["ids"]) == ["Hello  world, ñandú\nzwei", "x 日 y"][r["doc_id"] - 1]


def test_encode_and_decode_tables(frame):
    data = [(1, "some text"), (None, None), (2, ""), (2, "some text"), (3, "long " * 20000)]
    enc = sp.sample_encode(frame(data))
    back = sp.decode(enc)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(d, t or "") for d, t in data}
    assert sp.sample_encode(frame([])).count() == 0


# --- chat


def trained(turns):
    return "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize("budget,history", [(1024, 192), (60, 20), (1, 0)])
def test_chat_reads_back(spark, budget, history):
    rng = random.Random(7)
    bits = ["### ", "####", "</turn>", "\\", "\\\\n", "\n", "### assistant\n", "word ", "é", "<\\/turn>", "#\\#"]
    data = []
    for c in [None, -7, 1, 2, 3]:
        for t in range(12 if c != 3 else 1):
            role = "system" if t == 0 and c != 1 else ("odd\nrole: </turn>" if t == 5 else ("assistant" if t % 2 else "user"))
            data.append((c, t // 2 if c == 2 else t, role, None if t == 3 else "".join(rng.choice(bits) for _ in range(rng.randrange(30))), "extra"))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    windows = chat.format_windows(df, budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in {x[0] for x in data}:
        turns = [(r, t or "") for _, _, r, t in sorted((x[1], i, x[2], x[3]) for i, x in enumerate(data) if x[0] == c)]
        if c == 2:
            turns = [(r, t) for _, r, t in sorted((x[1], x[2], x[3] or "") for x in data if x[0] == c)]
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(trained(turns)), hashlib.sha256(trained(turns).encode()).hexdigest())
    rows_ = windows.collect()
    assert sum(len(r.formatted) for r in rows_) == sum(r.formatted_chars for r in got.values())
    for r in rows_:
        turns = chat.parse(r.formatted)
        assert len(turns) > r.n_repeated and (r.n_tokens <= budget or len(turns) - r.n_repeated == 1)
        if r.window and r.conv_id not in (1, 2):
            assert turns[0][0] == "system"


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# --- secrets


def base_spans(text):
    out = [(*m.span(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(*m.span(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], s[2]))


SECRET_TEXTS = [
    None, "", "é password = 'abcdefghijkl' x", "secret: token: abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIA12 AKIAAKIA", "ü 0123456789abcdef0 deadbeef", 'token="04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "api_key==abcdefghijkl API-KEY=zzzzzzzzzzzz apikey : 'qqqqqqqqqqqqqq", "key Zx9Kq2LmP4vT7wYb1NcR8dHs end", "550e8400-e29b-41d4-a716-446655440000", "someVeryLongIdentifierName2024 another_long_name_of_a_thing_12",
    "D41D8CD98F00B204E9800998ECF8427E", "plain words " * 3000 + "passwd=longenoughvalue1",
]


def test_secrets_base_matches_expressions(frame):
    got = {r.doc_id: r for r in secrets.scan(frame(list(enumerate(SECRET_TEXTS)))).collect()}
    for i, t in enumerate(SECRET_TEXTS):
        base = base_spans(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, z, k in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for *_, k in base) for x in range(3)]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[8].spans == "token:4:28"
    assert [got[i].n_token for i in (9, 10, 11)] == [0, 0, 0]


def test_long_lower_case_runs_take_no_time():
    """In a process of its own: a pattern that backtracks can't be interrupted."""
    code = "from larkspur.llm.secret_scan import KNOWN, NAME\nfor end in (b'=1', b'1234567'):\n    for n in (40, 100_000):\n        assert not KNOWN.fullmatch(b'ab' * (n // 2) + end) and not NAME.fullmatch(b'ab' * (n // 2) + end)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_random_strings_that_look_like_names(frame):
    rng = random.Random(5)
    keys = ["".join(rng.choice(a) for _ in range(n - 1)) + "7" for a in ("abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz234567") for n in (20, 24, 32, 50) for _ in range(25)]
    keys = [k for k in keys if not k.isdigit() and not re.search("[0-9a-f]{16}", k)] + ["kqzjxwvbhtmpgdzrfqxnl48213"]
    plain = "another_long_name_of_a_thing_12 test_col1_col2_col3_col4_col5 layer3_conv2_bn1_weight2 utf8mb4_unicode_ci_v2 some/path_to/plain_words_2024 thisIsAnotherVariableName3"
    got = {r.doc_id: r for r in secrets.scan(frame([*enumerate(f"see {k} here" for k in keys), (-1, plain)])).collect()}
    assert sum(secrets.NAME.fullmatch(k.encode()) is not None for k in keys) > len(keys) // 2
    assert [i for i, k in enumerate(keys) if got[i].spans != f"token:4:{4 + len(k)}"] == []
    assert got[-1].n_token == 0


def test_planted_keys_and_code_names():
    """Recall on random keys of 12 and more characters, and names that are no keys."""
    enc, rng = secrets.encoding(secrets.default_vocabulary()), random.Random(8)
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters, least in ((low + up + "0123456789", 0.99), (low + "0123456789", 0.95), (up + "234567", 0.88), (low + up, 0.9)):
        for n in (12, 16, 24, 40):
            texts = [f"see {''.join(rng.choice(letters) for _ in range(n))} here".encode() for _ in range(300)]
            hit = sum(any(a <= 4 and b >= 4 + n for a, b, _ in secrets.shapes(t) + secrets.random_runs(t, secrets.shapes(t), enc)) for t in texts)
            assert hit >= least * len(texts), (letters, n, hit)
    names = "getElementById parseHTMLDocument HttpServletRequest AbstractSingletonProxyFactoryBean python3-minimal base64EncodeString node_modules/react-dom/index2 2024-01-15T10-30-00Z PostgreSQLDatabase"
    assert secrets.random_runs(names.encode(), [], enc) == []


def test_runs_are_judged_once_and_fast():
    enc, rng = secrets.encoding(secrets.default_vocabulary()), random.Random(9)
    for end in (b"=1", b"1234567"):
        text = b"a" * 10_000 + end
        began = time.perf_counter()
        secrets.random_runs(text, secrets.shapes(text), enc)
        assert time.perf_counter() - began < 0.1
    bits = ["token=", "AKIA", "".join(rng.choice("ABCDEFGHJKLM23456789xyz") for _ in range(24)), "0123456789abcdef77", " ", "plain words ", "é", "-"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12))).encode()
        base = secrets.shapes(text)
        every = [s for s in secrets.random_runs(text, [], enc) if not any(x < s[1] and s[0] < y for x, y, _ in base)]
        assert secrets.random_runs(text, base, enc) == every


def test_redaction_is_what_the_scan_found(frame):
    """Texts rebuilt from the scan's spans, merged where they overlap and named by the first."""
    rows_ = list(enumerate(SECRET_TEXTS))
    found = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in secrets.scan(frame(rows_)).collect()}
    got = {r.doc_id: r.text for r in secrets.redact(frame(rows_)).collect()}
    for d, t in rows_:
        want, end = "", 0
        for kind, a, z in found[d]:
            if int(a) >= end:
                want += t[end : int(a)] + f"[{kind}]"
            end = max(end, int(z))
        assert got[d] == (None if t is None else want + t[end:])


def test_redaction_and_empty(frame):
    out = {r.doc_id: r.text for r in secrets.redact(frame([(1, "a token=abcdefghijklmnop b"), (2, None)])).collect()}
    assert out == {1: "a [assign] b", 2: None}
    assert secrets.scan(frame([])).count() == 0


# --- classifier


def corpus(n, seed):
    rng = random.Random(seed)
    stems = ["ba", "lo", "ni", "tes", "ra", "mu", "kel", "or"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        poor, toxic = rng.random() < 0.2, rng.random() < 0.2
        w = [word() for _ in range(rng.randrange(30, 120))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grolbek", "grolbat", "stupid", "moron", "vrakzu"])
        if poor:
            w = [x + rng.choice(["###", "$$$", "&&&"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, frame):
    docs, labels = corpus(900, 4)
    seen = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    model, report = clf.fit(frame(docs[:600]), seen)
    got = {r.doc_id: r for r in clf.score(frame(docs[600:]), model).collect()}
    right = [got[i].kept == bool(q and not t) for i, q, t in labels[600:]]
    assert np.mean(right) > 0.95
    assert report["toxic"]["accuracy"][0, 1] > 0.8


def test_fitting_reads_whole_texts(spark, frame):
    rng = random.Random(6)
    toxic = [rng.random() < 0.3 for _ in range(200)]
    docs = [(i, "ba lo ni tes " * 3200 + " ".join(rng.choice(["ra", "mu", "kel", "or"]) for _ in range(20)) + (" grolbek vrakzu" if bad else "")) for i, bad in enumerate(toxic)]
    seen = spark.createDataFrame([(i, 1, int(bad)) for i, bad in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model, report = clf.fit(frame(docs), seen)
    got = {r.doc_id: r.toxic for r in clf.score(frame(docs), model).collect()}
    assert report["toxic"]["n"] == 200 and np.mean([(got[i] >= 0.5) == bad for i, bad in enumerate(toxic)]) > 0.95
    assert clf.fit(frame(docs), seen, sample_bytes=1_020_000)[1]["toxic"]["n"] == 24


def test_em_finds_the_worse_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    flip = lambda p: np.where(rng.random(4000) < p, ~truth, truth).astype(int)
    votes = np.stack([flip(0.05), flip(0.1), flip(0.35), np.where(rng.random(4000) < 0.5, flip(0.05), -1)], axis=1)
    post, acc, prior = clf.accuracies(votes)
    assert ((post > 0.5) == truth).mean() > 0.95 and abs(prior - 0.3) < 0.05
    assert acc[2].mean() < acc[1].mean() < acc[0].mean()


def penalised(v, acc, prior):
    """Log-likelihood of votes under the labellers' model, with the prior of four right votes in five, summed row by row."""
    total = float((4 * np.log(acc) + np.log1p(-acc)).sum())
    for row in v:
        up, down = prior, 1 - prior
        for k, x in enumerate(row):
            if x >= 0:
                up *= acc[k, 1] if x == 1 else 1 - acc[k, 1]
                down *= acc[k, 0] if x == 0 else 1 - acc[k, 0]
        total += math.log(up + down)
    return total


@pytest.mark.parametrize("seed", range(4))
def test_em_against_direct_maximisation(seed):
    """No step from EM's result, along any parameter, is a better maximum; nor is the best of many random points."""
    rng = np.random.default_rng(seed)
    truth = rng.random(60) < 0.4
    v = np.stack([np.where(rng.random(60) < e, ~truth, truth).astype(int) for e in (0.1, 0.2, 0.3)], axis=1)
    v[rng.random(v.shape) < 0.2] = -1
    post, acc, prior = clf.accuracies(v, rounds=400)
    best = penalised(v, acc, prior)
    for k in range(3):
        for c in range(2):
            for step in (-0.01, 0.01):
                other = acc.copy()
                other[k, c] = np.clip(other[k, c] + step, 0.55, 0.995)
                assert penalised(v, other, prior) <= best + 1e-3
    for step in (-0.01, 0.01):
        assert penalised(v, acc, prior + step) <= best + 1e-3
    for _ in range(300):
        assert penalised(v, rng.uniform(0.55, 0.995, (3, 2)), rng.uniform(0.05, 0.95)) <= best + 1e-3


def test_training_against_brute_force_gradients():
    """The trained weights are where the slopes of the penalised loss, taken by differences, vanish."""
    rng = np.random.default_rng(1)
    n = 1200
    post = np.where(rng.random(n) < 0.3, 0.9, 0.1)
    has = np.stack([rng.random(n) < np.where(post > 0.5, p, q) for p, q in ((0.8, 0.05), (0.6, 0.1), (0.1, 0.7))], axis=1)
    doc, ids = np.nonzero(has)
    ids, w, bias = clf.train(doc, ids, post, rounds=4000)
    assert ids.tolist() == [0, 1, 2]
    count = has.sum(0)

    def loss(w, bias):
        s = has @ w + bias
        return float((np.log1p(np.exp(s)) - post * s).sum() + 0.5 * 1e-3 * (count * w * w).sum())

    for k in range(3):
        e = np.zeros(3)
        e[k] = 1e-4
        assert abs(loss(w + e, bias) - loss(w - e, bias)) / 2e-4 < 0.05 * count[k]
    assert abs(loss(w, bias + 1e-4) - loss(w, bias - 1e-4)) / 2e-4 < 0.02 * n
    assert w[0] > 0 > w[2]


def test_scores_are_the_linear_model_word_by_word():
    """Scores against a sum over the distinct features of each text by itself."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "betas", "gam!", "DELTA", "é"]) for _ in range(rng.randrange(12))) for _ in range(30)]
    one = lambda t: clf.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1]
    known = np.unique(np.concatenate([one(t) for t in texts]))[::2]
    weights = np.linspace(-1, 1, len(known))
    model = clf.Model([(known, weights, 0.3), (known[:3], weights[:3], -0.2)])
    data, ends = "".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts])
    got = model.score(np.frombuffer(data, np.uint8), ends)
    for i, t in enumerate(texts):
        s = 0.3 + sum(w for f, w in zip(known, weights) if f in set(one(t).tolist()))
        assert abs(got[i, 0] - 1 / (1 + math.exp(-s))) < 1e-9


def test_classifier_edges(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, _ = clf.fit(frame([(1, "a")]), none)
    assert clf.score(frame([(1, None), (None, ""), (2, "x" * 100000)]), model).count() == 3
    assert clf.score(frame([]), model).count() == 0

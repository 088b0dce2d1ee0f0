"""Quality and toxicity by weak labels: labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Several overlapping labellers vote on a bounded sample of labelled documents: the annotation in the
labels table, shape heuristics, a public word list, and lists of words and word beginnings learned from
the annotations of the other half of the sample. None is trusted as it stands: expectation-maximisation
estimates how often each is right from how they agree, and gives every sampled document a posterior.
The posteriors train a linear model over hashed features, and that model alone scores all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bytes_view as bv
from larkspur.llm.shared import documents

#: Labelled documents that the model is fitted on, at most; they are chosen by a hash of their ids.
SAMPLE = 8000
#: Bytes of the sampled texts together, at most, or one text: a bound of the driver's memory. Texts are never cut.
SAMPLE_BYTES = 320_000_000
PREFIX = 5
TARGETS = ("poor", "toxic")
# Common English insults.
INSULTS = (
    "idiot", "idiots", "stupid", "moron", "morons", "dumb", "fool", "loser", "losers", "trash", "garbage", "scum", "pathetic",
    "worthless", "disgusting", "clown", "ugly", "imbecile", "jerk", "filth", "vermin", "hate", "despicable", "useless",
)

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature id) of words, word beginnings and shapes, and the shapes as numbers (texts x 6).

    Feature ids are 32-bit hashes. Shapes: symbols, upper-case letters, exclamation marks and bars per
    word, repeated words per word, letters per word.
    """
    n = len(offsets) - 1
    low = _LOWER[buf]
    dark = np.zeros(len(buf) + 2, bool)
    dark[1:-1] = _TOKEN[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(dark[1:] & (~dark[:-1] | edge))
    ends = np.flatnonzero(dark[:-1] & (~dark[1:] | edge))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if len(starts):
        both = bv.spans_hash(low, np.concatenate([starts, starts]), np.concatenate([ends, np.minimum(ends, starts + PREFIX)]))
        word, begin = both[: len(starts)], bv.mix(both[len(starts) :] + bv.GOLD)
    else:
        word = begin = np.zeros(0, np.uint64)
    long = ends - starts > PREFIX
    words = np.bincount(doc, minlength=n)
    per = np.maximum(words, 1)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / per
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = np.stack(
        [
            count(np.isin(buf, np.frombuffer(b"#*$%&<>", np.uint8))),
            count((buf >= 65) & (buf <= 90)),
            count(buf == 33),
            count(buf == 124),
            np.bincount(doc, weights=again, minlength=n) / per,
            np.bincount(doc, weights=ends - starts, minlength=n) / per,
        ],
        axis=1,
    )
    bins = np.floor(np.log2(shape * 64 + 1)).astype(np.int64)
    shape_id = bv.mix((np.arange(6, dtype=np.uint64)[None, :] * np.uint64(1000) + bins.astype(np.uint64) + np.uint64(7)) * bv.GOLD)
    docs = np.concatenate([doc, doc[long], np.repeat(np.arange(n), 6)])
    ids = np.concatenate([word, begin[long], shape_id.ravel()]) >> np.uint64(32)
    return docs, ids.astype(np.int64), shape


INSULT_IDS = None


def _insults() -> np.ndarray:
    global INSULT_IDS
    if INSULT_IDS is None:
        raw = [w.encode() for w in INSULTS]
        ends = np.cumsum([len(w) for w in raw])
        INSULT_IDS = (bv.spans_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends) >> np.uint64(32)).astype(np.int64)
    return INSULT_IDS


def associated(doc: np.ndarray, ids: np.ndarray, positive: np.ndarray, use: np.ndarray, least: int = 5, odds: float = 4.0) -> np.ndarray:
    """Features far more frequent among the positive documents of ``use`` than among the others."""
    own = use[doc]
    d, f = doc[own], ids[own]
    feature, inv = np.unique(f, return_inverse=True)
    pos = np.bincount(inv, weights=positive[d], minlength=len(feature))
    every = np.bincount(inv, minlength=len(feature))
    n_pos, n = positive[use].sum(), use.sum()
    lift = np.log((pos + 0.1) / (n_pos + 0.2)) - np.log((every - pos + 0.1) / (n - n_pos + 0.2))
    return feature[(pos >= least) & (lift > odds)]


def votes(doc: np.ndarray, ids: np.ndarray, shape: np.ndarray, gold: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """For each target a matrix (documents x labellers) of 0, 1, and -1 for no vote; 1 is poor, or toxic.

    gold: annotations (documents x 2), -1 where missing.
    """
    n = len(shape)

    def hits(some: np.ndarray, of: np.ndarray) -> np.ndarray:
        m = np.isin(ids, some) & of[doc]
        return np.bincount(doc[m], minlength=n)

    def by_rate(x: np.ndarray, high: float, low: float) -> np.ndarray:
        return np.where(x > high, 1, np.where(x <= low, 0, -1))

    every = np.ones(n, bool)
    out = []
    for t in range(2):
        learned = np.full(n, -1)
        for k in (0, 1):
            some = associated(doc, ids, (gold[:, t] == 1).astype(float), (fold == k) & (gold[:, t] >= 0))
            h = hits(some, fold != k)
            v = np.where(h >= 2, 1, np.where(h == 0, 0, -1))
            learned[fold != k] = v[fold != k]
        if t == 0:
            own = [by_rate(shape[:, 0], 0.5, 0.05), by_rate(shape[:, 1], 2.5, 1.0), by_rate(shape[:, 2], 0.5, 0.05), by_rate(shape[:, 3], 0.3, 0.01), by_rate(shape[:, 4], 0.15, 0.05)]
            own = [np.where(v == 1, 1, -1) for v in own] + [np.where(np.stack([v == 0 for v in own]).all(0), 0, -1)]
        else:
            own = [np.where(hits(_insults(), every) > 0, 1, -1)]
        out.append(np.stack([gold[:, t], learned, *own], axis=1))
    return out


def accuracies(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of class 1 per row, accuracy per labeller and class, prior) by expectation-maximisation.

    Labellers err independently given the class; an abstention says nothing. Accuracies start at 0.8, the
    posterior from the majority of votes, and a weak Beta prior keeps rare labellers from certainty.
    """
    cast = v >= 0
    one = v == 1
    acc = np.full((v.shape[1], 2), 0.8)
    prior = min(0.9, max(0.02, one.sum() / max(cast.sum(), 1)))
    post = np.zeros(len(v))
    for _ in range(rounds):
        up = np.where(cast, np.where(one, np.log(acc[:, 1]), np.log1p(-acc[:, 1])), 0.0).sum(1) + np.log(prior)
        down = np.where(cast, np.where(one, np.log1p(-acc[:, 0]), np.log(acc[:, 0])), 0.0).sum(1) + np.log1p(-prior)
        post = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        w1, w0 = post[:, None] * cast, (1 - post[:, None]) * cast
        acc[:, 1] = ((w1 * one).sum(0) + 4) / (w1.sum(0) + 5)
        acc[:, 0] = ((w0 * ~one).sum(0) + 4) / (w0.sum(0) + 5)
        acc = np.clip(acc, 0.55, 0.995)
        prior = float(np.clip(post.mean(), 0.005, 0.95))
    return post, acc, prior


def train(doc: np.ndarray, ids: np.ndarray, post: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on presence of features, towards soft labels: (feature ids, weights, bias).

    Only features whose frequency differs clearly between the classes take part, so that the many words of
    a long text add no noise.
    """
    pair = np.unique(np.stack([doc, ids]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    d, f = pair
    feature, inv = np.unique(f, return_inverse=True)
    n, n_pos = len(post), post.sum()
    pos, every = np.bincount(inv, weights=post[d], minlength=len(feature)), np.bincount(inv, minlength=len(feature))
    p = n_pos / max(n, 1)
    z = (pos - every * p) / np.sqrt(every * max(p * (1 - p), 1e-6) + 1.0)
    pick = np.flatnonzero((every >= 3) & ((z > 4.0) | (z < -6.0)))
    row = np.full(len(feature), -1)
    row[pick] = np.arange(len(pick))
    use = row[inv] >= 0
    d, c = d[use], row[inv][use]
    w, bias = np.zeros(len(pick)), float(np.log(max(p, 1e-3) / max(1 - p, 1e-3)))
    lr = 1.0 / (0.25 * max(1.0, np.bincount(d, minlength=n).mean() if len(d) else 1.0))
    m = np.zeros(len(pick))
    rate = np.maximum(np.bincount(c, minlength=len(pick)), 1) ** 0.5
    for _ in range(rounds):
        s = np.bincount(d, weights=w[c], minlength=n) + bias
        err = 1 / (1 + np.exp(-np.clip(s, -50, 50))) - post
        g = np.bincount(c, weights=err[d], minlength=len(pick)) / rate + penalty * w * rate
        m = 0.9 * m + g
        w -= lr * 0.1 * m
        bias -= 0.5 * err.mean()
    return feature[pick], w, bias


class Model:
    """Feature ids in order, their weights for both targets, and biases. Size: the sample's vocabulary at most."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        self.ids = np.unique(np.concatenate([p[0] for p in parts]))
        self.weights = np.zeros((2, len(self.ids)))
        for t, (ids, w, _) in enumerate(parts):
            self.weights[t, np.searchsorted(self.ids, ids)] = w
        self.bias = np.array([p[2] for p in parts])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.ids & 0xFFFFF] = True

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of poor and of toxic for each text (texts x 2)."""
        doc, ids, _ = features(buf, offsets)
        hit = self.maybe[ids & 0xFFFFF]
        doc, ids = doc[hit], ids[hit]
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        real = self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), bool)
        pair = np.unique(doc[real] * (len(self.ids) + 1) + at[real])
        doc, at = pair // (len(self.ids) + 1), pair % (len(self.ids) + 1)
        s = np.stack([np.bincount(doc, weights=self.weights[t, at], minlength=len(offsets) - 1) for t in range(2)], axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[Model, dict]:
    """The model and what is known of its labellers. Reads at most ``sample`` labelled documents.

    The sample is the labelled ids with the smallest hashes, so reruns agree; only its features come to
    the driver. Whole texts are read; where they exceed ``sample_bytes`` together, fewer documents are taken.
    Without labelled documents the model rests on the heuristics of no document and scores its bias.
    """
    chosen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(text).cast("long").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n"))
    total, taken = 0, []
    for r in sorted(sizes.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").collect()):
        total += r.n
        if taken and total > sample_bytes:
            chosen = chosen.where(F.col("doc_id").isin(taken))
            break
        taken.append(r.doc_id)
    rows = docs.select("doc_id", text.cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "toxic", "text")

    def look(batches):
        for b in batches:
            for lo, hi, buf, offsets in bv.chunks(b.column(3)):
                doc, ids, shape = features(buf, offsets)
                pair = np.unique(doc << 32 | ids)
                counts = np.bincount(pair >> 32, minlength=hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(pair & 0xFFFFFFFF))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * 6), pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(k).slice(lo, hi - lo).cast(pa.int64()) for k in range(3)] + [lists, flat], names=["doc_id", "quality", "toxic", "ids", "shape"])

    got = rows.mapInArrow(look, "doc_id long, quality long, toxic long, ids array<long>, shape array<double>").toArrow().combine_chunks().sort_by("doc_id")
    n = got.num_rows
    if not n:
        return Model([(np.zeros(0, np.int64), np.zeros(0), -2.0)] * 2), {}
    lists = pa.concat_arrays(got.column("ids").chunks)
    ids = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    shape = pa.concat_arrays(got.column("shape").chunks).flatten().to_numpy().reshape(n, 6)
    known = [got.column(c).fill_null(-1).to_numpy() for c in ("quality", "toxic")]
    gold = np.stack([np.where(known[0] < 0, -1, 1 - known[0]), known[1]], axis=1)
    key = got.column("doc_id").to_numpy().astype(np.uint64)
    fold = (bv.mix(key + bv.GOLD) & np.uint64(1)).astype(np.int64)
    parts, report = [], {}
    for target, v in zip(TARGETS, votes(doc, ids, shape, gold, fold)):
        post, acc, prior = accuracies(v)
        parts.append(train(doc, ids, post))
        report[target] = {"accuracy": acc, "prior": prior, "n": n, "features": len(parts[-1][0])}
    return Model(parts), report


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, poor, toxic (probabilities), kept (neither reaches the threshold).

    Whole texts are read. Null text is empty and scores by its shape alone; ids are carried as they are,
    null or repeated. The model travels with the tasks; its size is bounded by its sample.
    """

    def run(batches):
        for b in batches:
            for lo, hi, buf, offsets in bv.chunks(b.column(1)):
                p = np.round(model.score(buf, offsets), 6)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < threshold).all(1))], names=["doc_id", "poor", "toxic", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, poor double, toxic double, kept boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, _ = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model)


QUERIES = {"op9_quality_classifier": op9}
ORACLES: dict[str, str] = {}

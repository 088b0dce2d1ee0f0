"""Spelling variants: words of a corpus that are one edit apart, grouped under the frequent form.

Two words one edit apart agree exactly in a half: cut the shorter one in the middle, and either what stands
before the cut begins the other word and the error is behind it, or what stands behind the cut ends the other
word and the error is before it. Every word is dealt out under both halves, as of its own length and as of the
length below (where it is the longer one), so that near words meet in a group. A task makes of its groups a forward
minimal acyclic automaton and a backward one, whose transitions count the words they skip: a path gives the
number of its word. A query walks its exact half from the outside and completes the rest with one error.

A group of more words than fit is cut again: what is free between the halves is halved, and an error is in one of
them. So groups stay bounded however many words begin or end alike, and no pair is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bytes_view as bv
from larkspur.llm.shared import documents, staged, unstage

#: Code points of a word, and occurrences, at least; how many times as frequent a form is as its variant.
LENGTH = 6
OCCURRENCES = 5
RATIO = 5
#: One run in so many loses a code point.
DROPPED = 199
#: Words of a group at most while it can be cut, and of a task's automata.
GROUP = 20_000
#: Bytes from which on a run's checksum is taken on its own.
LONG = 64

#: What a byte makes of the checksum's register, taken from the checksums of single bytes (which begin and end with all bits turned).
_CRC = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, code points and row of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8."""
    letter = np.zeros(len(buf) + 2, bool)
    lead = buf == 0xC3
    letter[1:-1] = (buf >= 65) & (buf <= 90) | (buf >= 97) & (buf <= 122) | lead
    letter[2:-1] |= lead[:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
    wide = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, ends - starts - (wide[ends] - wide[starts]), np.searchsorted(offsets, starts, side="right") - 1


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, going on from the checksum ``before`` it."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = np.flatnonzero(size <= LONG)
    order = order[np.argsort(-size[order], kind="stable")]
    c, at, size = before[order] ^ np.uint64(0xFFFFFFFF), starts[order], size[order]
    on = np.searchsorted(-size, -np.arange(1, LONG + 1), side="right")  # spans that have another byte
    for j, n in enumerate(on.tolist()):
        if not n:
            break
        c[:n] = _CRC[(c[:n] ^ buf[at[:n] + j]) & np.uint64(255)] ^ (c[:n] >> np.uint64(8))
    out[order] = c ^ np.uint64(0xFFFFFFFF)
    return out


def count_words(buf: np.ndarray, offsets: np.ndarray, ids: list, length: int, dropped: int) -> tuple[list[str], list[int]]:
    """The words of some texts, with their occurrences."""
    starts, ends, size, row = runs(buf, offsets)
    some = size >= length  # shorter ones do not count, nor do they after losing a code point
    starts, ends, size, row = (x[some] for x in (starts, ends, size, row))
    low = _LOWER[buf]
    before = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in ids], np.uint64)
    crc = checksums(low, starts, ends, before[row])
    cut = crc % np.uint64(dropped) == 0
    found: Counter = Counter()
    for i in np.flatnonzero(cut).tolist():
        word = low[starts[i] : ends[i]].tobytes().decode()
        if len(word) > length:
            k = int(crc[i]) % len(word)
            found[word[:k] + word[k + 1 :]] += 1
    starts, ends = starts[~cut], ends[~cut]
    _, first, n = np.unique(bv.spans_hash(low, starts, ends), return_index=True, return_counts=True)
    raw = low.tobytes()
    for i, j, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
        found[raw[i:j].decode()] += k
    return list(found), list(found.values())


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, dropped: int = DROPPED) -> DataFrame:
    """word, n: the words of at least ``length`` code points and ``occurrences``. Counts combine before they are shuffled."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, buf, offsets in bv.chunks(b.column(1)):
                words, n = count_words(buf, offsets, ids[lo:hi], length, dropped)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Automaton:
    """Minimal acyclic automaton of sorted, different words: ``edges[state][symbol]`` is the next state and how many words of
    ``state`` come before those behind the symbol, ``final`` the states in which a word ends."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[list[bool], list]] = [([False], [])]
        last = ""
        for w in words:
            k, most = 0, min(len(w), len(last))
            while k < most and w[k] == last[k]:
                k += 1
            self._close(path, last, k)
            path.extend(([False], []) for _ in range(len(w) - k))
            path[-1][0][0] = True
            last = w
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((word[len(path) - 1], self._state(*node)))

    def _state(self, final: list[bool], out: list[tuple[str, int]]) -> int:
        """The state of this future: the one known, or a new one."""
        key = (final[0], *out)
        if key not in self._known:
            n, edges = int(final[0]), {}
            for symbol, to in out:
                edges[symbol] = to, n
                n += self._count[to]
            self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final[0])
            self._count.append(n)
        return self._known[key]

    def one_error(self, word: str, exact: int, free: int) -> set[int]:
        """Numbers of the words that differ from ``word``, which is one of them, by a replaced or an inserted symbol behind
        its first ``exact`` symbols and before what follows the next ``free`` ones."""
        edges, final, found = self.edges, self.final, set()
        state, number, upto = self.start, 0, exact + free
        for i, own in enumerate(word):
            if i >= exact:
                if i > upto:
                    break
                for symbol, (to, skipped) in edges[state].items():
                    # an inserted symbol equal to the next one is found one place further on
                    rests = ((i + 1, i) if symbol != own else ()) if i < upto else (i,)
                    for j in rests:
                        at, n = to, number + skipped
                        for k in range(j, len(word)):
                            step = edges[at].get(word[k])
                            if step is None:
                                break
                            at, n = step[0], n + step[1]
                        else:
                            if final[at]:
                                found.add(n)
            state, skipped = edges[state][own]
            number += skipped
        if upto == len(word):
            found.update(number + skipped for to, skipped in edges[state].values() if final[to])
        return found


def near_words(rows: list[tuple[str, int, int, int, int]], reverse: bool) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n), from rows (word, n, base length, exact symbols at the beginning, at the end); both ways for an inserted symbol."""
    turn = (lambda w: w[::-1]) if reverse else (lambda w: w)
    n_of = {turn(r[0]): r[1] for r in rows}
    words = sorted(n_of)
    automaton = Automaton(words)
    for word, n, base, ahead, behind in rows:
        if len(word) == base:
            exact = behind if reverse else ahead
            for i in automaton.one_error(turn(word), exact, base - ahead - behind):
                near = turn(words[i])
                yield word, near, n_of[words[i]]
                if len(near) > len(word):
                    yield near, word, n


def links(words: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """word, near, near_n: every pair of near words of a vocabulary, each way once."""
    size = F.char_length("word")
    base = F.explode(F.filter(F.array(size, size - 1), lambda x: x >= length)).alias("base")
    dealt = words.select("word", "n", base)
    half = F.floor(F.col("base") / 2).cast("int")
    sides = F.array(F.struct(half.alias("ahead"), F.lit(0).alias("behind")), F.struct(F.lit(0).alias("ahead"), (F.col("base") - half).alias("behind")))
    now = dealt.select("word", "n", "base", F.inline(sides))
    key = F.xxhash64("base", "ahead", "behind", F.expr("left(word, ahead)"), F.expr("right(word, behind)"))
    free = F.col("base") - F.col("ahead") - F.col("behind")
    parts = []
    while True:
        now = now.withColumn("key", key)
        hot = staged(now.where(free > 1).groupBy("key").count().where(F.col("count") > group).select("key"), "spelling-hot")
        if hot.isEmpty():
            parts.append(now)
            break
        parts.append(now.join(hot, "key", "left_anti"))
        left = F.floor(free / 2).cast("int")
        inner = F.array(F.struct((F.col("ahead") + left).alias("ahead"), "behind"), F.struct("ahead", (F.col("behind") + free - left).alias("behind")))
        now = staged(now.where(free > 1).join(hot, "key", "left_semi").select("word", "n", "base", F.inline(inner)), "spelling-parts")

    def run(batches):
        held: list[tuple] = []
        last = None

        def done():
            found = [x for reverse in (False, True) if (own := [r for r in held if (r[4] > r[3]) == reverse]) for x in near_words(own, reverse)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for k, row in zip(cols[0], zip(*cols[1:])):
                if k != last and len(held) >= group:
                    yield done()
                    held.clear()
                held.append(row)
                last = k
        if held:
            yield done()

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.select("key", "word", "n", "base", "ahead", "behind")
    met = every.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near string, near_n long")
    return met.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame, length: int = LENGTH, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row (word, n) of a vocabulary.

    ``form``: the near word of largest n (of equals the first by code points) if its n is at least ``ratio`` times
    the word's, else null; ``root``: the last word that forms lead to, or the word. A form is more frequent by a factor,
    so chains are short and have no circle.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    own = links(words, length, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    form = -F.col("best.n") >= ratio * F.col("n")
    placed = words.join(own, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    placed = staged(placed, "spelling-forms")
    to = staged(placed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # each round doubles the steps that a root is away
        after = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = staged(to.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        unstage(to)
        to = further
        if to.where("moved").isEmpty():
            break
    return placed.join(to.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO, dropped: int = DROPPED, group: int = GROUP) -> DataFrame:
    """The words of whole texts with their forms and roots; see ``variants``.

    Words are maximal runs of A-Z, a-z, U+00C0 to U+00FF with A-Z in lower case. One run in ``dropped``, by a checksum of id and
    run, loses a code point first. Null texts have no words, a null id is written as nothing, repeated rows count each, no
    words give no rows. Rows go to the shared folder once; only the vocabulary is shuffled.
    """
    words = staged(vocabulary(docs, id_col, text_col, length, occurrences, dropped), "spelling-words")
    return variants(words, length, ratio, group)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


#: The checksum is taken bit by bit; near words meet in strings with a place left open or left out.
_SQL = f"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL HAVING length(run) >= {LENGTH}),
bytes AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM low),
bits AS (SELECT run, n, list_transform(range(4 * length(x)), lambda i: ((instr('0123456789ABCDEF', substr(x, 2 * (i // 8) + 2 - (i % 8) // 4, 1)) - 1) >> (i % 4)) & 1) AS b FROM bytes),
sums AS (SELECT run, n, xor(4294967295, list_reduce(b, lambda c, d: xor(c >> 1, 3988292384 * (xor(c, d) & 1)), CAST(4294967295 AS BIGINT))) AS h FROM bits),
said AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM sums),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, (-n, near)) AS near FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN near END AS form, CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n FROM w LEFT JOIN best USING (word)),
r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word)"""

QUERIES = {"op11_spelling_variants": op11}
ORACLES: dict[str, str] = {"op11_spelling_variants": _SQL}

"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text holds every way to spell it with pieces (a character without a piece is spelled by
its bytes). Pieces weigh as a power law of their rank, since the vocabulary's own scores are merge
ranks and no probabilities; backward sums over the lattice give each segmentation its exact
probability. Sampling k of them without replacement is a race: a segmentation of probability p arrives
at an exponential time of rate p, whose negative logarithm is the Gumbel-perturbed log-probability, and
the first k arrivals are the sample. The search is A*: a node is a prefix of the text's lattice, its
bound is the first arrival below it, which is exact; a popped node is followed down to its arrival, and
each alternative left on the way becomes a node of its own (all of them beyond a certain depth at first
one node, which is opened only if it is popped). Every draw is a function of the seed, the row's key and
the place in its text, so results do not depend on batches, partitions or retries.

Pieces never span the start of a word, so the lattice of a word is built once for all texts of a worker, as
long as it is kept, and the walks of the texts of a chunk advance together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import bytes_view as bv
from larkspur.llm.shared import documents

SAMPLES = 2
SEED = 20
#: Power of the piece's rank in its weight.
POWER = 1.0
#: Tokens after a divergence whose alternatives become nodes at once.
DEPTH = 48
#: Characters of text walked together.
CHUNK = 300_000
#: Edges of the words' lattices that a worker keeps, about 26 bytes each; beyond, it starts anew.
KEPT_EDGES = 2_000_000
META = 0x2581  # stands for a space in pieces
LITERAL = 0x110000  # that character itself, in a text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _uniform(key: np.ndarray, leaf: int, place: np.ndarray, salt: int = 0) -> np.ndarray:
    """In (0, 1), fixed by the row's key, the leaf, the place in the text and a salt."""
    h = bv.mix(key + (place.astype(np.uint64) * np.uint64(2654435761) + np.uint64(leaf * 7919 + salt * 104729 + 1)) * bv.GOLD)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """The pieces of a SentencePiece model: a trie in one hash table, weights, and bytes for decoding."""

    def __init__(self, path: str, power: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        text = [b""] * n
        trie: dict[tuple[int, int], int] = {}
        piece_of, rank, inner = [-1], np.full(n, n, np.int64), set()
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text[i] = p.replace("▁", " ").encode()
                rank[i] = i
                if len(p) > 1:
                    inner.update(map(ord, p))
                at = 0
                for c in p:
                    key = (at, ord(c))
                    if key not in trie:
                        trie[key] = len(piece_of)
                        piece_of.append(-1)
                    at = trie[key]
                piece_of[at] = i
        least = rank.min()
        self.log_weight = -power * np.log(rank - least + 2.0)
        self.unknown = -power * np.log(n) - 2.0  # for each byte
        self.piece_of = np.array(piece_of, np.int64)
        self.alone = np.ones(LITERAL + 1, bool)  # in no piece but perhaps its own
        self.alone[list(inner)] = False
        bits = max(10, int(np.ceil(np.log2(4 * len(trie)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        keys = np.array([s << 21 | c for s, c in trie], np.int64)
        for k, slot, to in zip(keys.tolist(), ((keys.astype(np.uint64) * bv.GOLD) >> self.shift).tolist(), trie.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = k, to
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.bytes = np.frombuffer(b"".join(text) or b"\0", np.uint8)
        self.lattices = Lattices(self)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's next states, -1 where there is none."""
        key = (state << 21) | char
        slot = ((key.astype(np.uint64) * bv.GOLD) >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes that the pieces spell, with the space that stands before every text."""
        return self.bytes[bv.ranges(self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])]


@lru_cache(2)
def vocabulary(path: str, power: float) -> Vocabulary:
    return Vocabulary(path, power)


class Lattice:
    """All segmentations of each word in ``chars``; words lie one after the other and end at ``ends``.

    The edges from position p are ``off[p]`` to ``off[p + 1]``, longest first: their length, their piece
    (from ``size`` on: size + character, for a character without a piece), their log-probability given
    that p is reached, and the running sum of probabilities from p on.
    """

    def __init__(self, v: Vocabulary, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = len(chars)
        end = np.repeat(ends, ends - starts)
        at, state, depth, found = np.arange(n), np.zeros(n, np.int64), 0, []
        while len(at):
            state = v.step(state, chars[at + depth])
            ok = state >= 0
            at, state = at[ok], state[ok]
            piece = v.piece_of[state]
            hit = piece >= 0
            depth += 1
            found.append((at[hit], np.full(int(hit.sum()), depth), piece[hit]))
            more = at + depth < end[at]
            at, state = at[more], state[more]
        single = np.zeros(n, bool)
        if found:
            single[found[0][0]] = True
        lone = np.flatnonzero(~single)
        found.insert(0, (lone, np.ones(len(lone), np.int64), v.size + chars[lone]))
        counts = np.zeros(n + 1, np.int64)
        for at, _, _ in found:
            counts[at] += 1
        self.off = off = np.concatenate([[0], np.cumsum(counts[:n])])
        self.len, self.piece = np.empty(off[-1], np.int32), np.empty(off[-1], np.int32)
        free = off[1:].copy()
        for at, length, piece in found:
            free[at] -= 1
            self.len[free[at]], self.piece[free[at]] = length, piece
        known = self.piece < v.size
        weight = np.where(known, v.log_weight[np.minimum(self.piece, v.size - 1)], v.unknown * _n_bytes(self.piece - v.size))
        # backward sums, position by position from the words' ends, all words at once
        start = np.repeat(np.arange(n), counts[:n])
        left = end - np.arange(n)
        beta = np.zeros(n + 1)
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, left.max() + 2 if n else 1))
        to = start + self.len
        inside = to < end[start] if n else np.zeros(0, bool)
        for a, b in zip(bounds[:-1], bounds[1:]):
            p = by_left[a:b]
            e = bv.ranges(off[p], counts[p])
            val = weight[e] + np.where(inside[e], beta[to[e]], 0.0)
            first = np.cumsum(counts[p]) - counts[p]
            beta[p] = np.logaddexp.reduceat(val, first)
        self.logp = weight + np.where(inside, beta[np.minimum(to, n)], 0.0) - beta[start]
        # running sums by rank among a position's edges, so that they do not depend on the words around
        self.cum = np.exp(self.logp)
        e, last = off[:-1] + 1, off[1:]
        while len(e):
            on = e < last
            e, last = e[on], last[on]
            self.cum[e] += self.cum[e - 1]
            e = e + 1
        self.cum[off[1:] - 1] = 2.0


class Lattices:
    """The lattices of the words met so far, one after the other, found by the words' hashes."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.hash, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.positions = self.edges = 0
        self._off, self._columns = np.zeros(1024, np.int64), {c: np.zeros(1024, t) for c, t in (("len", np.int32), ("piece", np.int32), ("logp", np.float64), ("cum", np.float64))}

    def _append(self, more: Lattice) -> None:
        n, m = self.positions + len(more.off) - 1, self.edges + len(more.len)
        if n + 1 > len(self._off):
            self._off = np.resize(self._off, 2 * n)
        self._off[self.positions + 1 : n + 1] = more.off[1:] + self.edges
        for c, held in self._columns.items():
            if m > len(held):
                self._columns[c] = held = np.resize(held, 2 * m)
            held[self.edges : m] = getattr(more, c)
        self.positions, self.edges = n, m

    def find(self, h: np.ndarray, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the lattice of each word begins; ``h`` are their hashes, in order and each once."""
        if self.edges > KEPT_EDGES:
            self.clear()
        i = np.searchsorted(self.hash, h)
        new = np.ones(len(h), bool)
        inside = i < len(self.hash)
        new[inside] = self.hash[i[inside]] != h[inside]
        if new.any():
            size = sizes[new]
            ends = np.cumsum(size)
            begin = self.positions
            self._append(Lattice(self.v, chars[bv.ranges(starts[new], size)], ends - size, ends))
            self.hash, self.at = np.insert(self.hash, i[new], h[new]), np.insert(self.at, i[new], begin + ends - size)
            i = np.searchsorted(self.hash, h)
        self.off = self._off[: self.positions + 1]
        self.len, self.piece, self.logp, self.cum = (self._columns[c][: self.edges] for c in ("len", "piece", "logp", "cum"))
        return self.at[i]

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = self.off[state]
        left = np.flatnonzero(u >= self.cum[e])
        while len(left):
            e[left] += 1
            left = left[u[left] >= self.cum[e[left]]]
        return e


def _n_bytes(cp: np.ndarray) -> np.ndarray:
    """Bytes of a character in UTF-8."""
    return 1 + (cp >= 0x80) + ((cp >= 0x800)).astype(np.int64) + ((cp >= 0x10000) & (cp != LITERAL))


class Walks:
    """The sampled segmentations of a chunk of texts."""

    def __init__(self, v: Vocabulary, texts: list[str], keys: np.ndarray) -> None:
        self.v, self.keys, self.n = v, keys, len(texts)
        flat = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.doc_end = np.cumsum(lengths)
        self.doc_start = self.doc_end - lengths
        flat[flat == META] = LITERAL
        flat[flat == 32] = META
        self.total = n = len(flat)
        meta, alone = flat == META, v.alone[flat]
        first = np.zeros(n + 1, bool)
        first[self.doc_start[lengths > 0]] = True
        first[1:n] |= meta[1:] & ~meta[:-1] | alone[1:] | alone[:-1]
        self.w_start = np.flatnonzero(first[:n])
        self.w_end = np.append(self.w_start[1:], n) if n else self.w_start
        # distinct words by a 64-bit hash of their characters
        h = bv.symbols_hash(flat, self.w_start, self.w_end)
        distinct, index, inv = np.unique(h, return_index=True, return_inverse=True)
        self.lattice = v.lattices
        at = self.lattice.find(distinct, flat, self.w_start[index], (self.w_end - self.w_start)[index])
        self.shift = at[inv] - self.w_start  # from a place to its lattice position, by word
        self.w_doc = np.searchsorted(self.doc_end, self.w_start, side="right")

    def walk(self, leaf: int, edge_at: np.ndarray, place: np.ndarray, word: np.ndarray) -> None:
        """Draw on from each place to the end of its word, all together; edges go to ``edge_at``."""
        lat, end, shift = self.lattice, self.w_end[word], self.shift[word]
        key, base = self.keys[self.w_doc[word]], self.doc_start[self.w_doc[word]]
        while len(place):
            e = lat.draw(place + shift, _uniform(key, leaf, place - base))
            edge_at[place] = e
            place = place + lat.len[e]
            on = place < end
            place, end, shift, key, base = place[on], end[on], shift[on], key[on], base[on]

    def alternatives(self, leaf: int, docs: np.ndarray, token_at: np.ndarray, token_end: np.ndarray, mass: np.ndarray, whole: np.ndarray, arrival: np.ndarray, places: np.ndarray, edges: np.ndarray, depth: int, given: bool) -> dict:
        """Nodes for what the leaf leaves aside at its tokens from ``token_at`` on, for some documents.

        mass: log-probability of the prefix before; whole: that of the leaf; arrival: log-time. given: the
        first arrival among the nodes is ``arrival`` itself.
        """
        lat = self.lattice
        upto = np.minimum(token_at + depth, token_end)
        count = upto - token_at
        t = bv.ranges(token_at, count)
        which = np.repeat(np.arange(len(docs)), count)
        e, p = edges[t], places[t]
        run = np.concatenate([[0.0], np.cumsum(lat.logp[e])])
        at = np.cumsum(count) - count
        before = mass[which] + run[:-1] - run[at][which]
        after = mass + run[at + count] - run[at]
        state = p + self.shift[self.word_at(p)]
        n_alt = lat.off[state + 1] - lat.off[state]
        alt = bv.ranges(lat.off[state], n_alt)
        src = np.repeat(np.arange(len(t)), n_alt)
        other = alt != e[src]
        alt, src = alt[other], src[other]
        nodes = {"doc": docs[which[src]], "place": p[src], "edge": alt.astype(np.int64), "mass": before[src] + lat.logp[alt], "token": t[src], "k": which[src]}
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(upto < token_end, after + np.log(-np.expm1(np.minimum(whole - after, 0.0))), -np.inf)
        deep = np.flatnonzero(rest > -np.inf)
        more = {"doc": docs[deep], "place": np.full(len(deep), -1), "edge": np.full(len(deep), -1), "mass": after[deep], "token": upto[deep], "k": deep}
        rate = np.concatenate([nodes["mass"], rest[deep]])
        nodes = {c: np.concatenate([nodes[c], more[c]]) for c in nodes}
        key = self.keys[nodes["doc"]]
        local = np.where(nodes["edge"] >= 0, nodes["place"] - self.doc_start[nodes["doc"]], 1 << 40) * 64
        local = local + np.where(nodes["edge"] >= 0, lat.len[np.maximum(nodes["edge"], 0)], 0)
        wait = lambda salt: np.log(-np.log(_uniform(key, leaf, local, salt))) - rate
        nodes["arrival"] = np.logaddexp(arrival[nodes["k"]], wait(1))
        if given and len(rate):
            order = np.lexsort((wait(2), nodes["k"]))
            winner = order[np.concatenate([[True], nodes["k"][order][1:] != nodes["k"][order][:-1]])]
            nodes["arrival"][winner] = arrival[nodes["k"][winner]]
        nodes["leaf"] = np.full(len(rate), leaf)
        return nodes

    def word_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.w_start, place, side="right") - 1

    def sample(self, k: int) -> list[dict]:
        """Up to k leaves per text: arrays doc, arrival, logp, edges and token counts; and the arrival after them."""
        n, lat = self.n, self.lattice
        every = np.arange(n)
        arrival = np.log(-np.log(_uniform(self.keys, 0, np.full(n, 1 << 41), 3)))
        edge_at = np.full(self.total, -1, np.int32)
        self.walk(0, edge_at, self.w_start, np.arange(len(self.w_start)))
        leaves, pool = [], None
        docs, begin, mass = every, self.doc_start.copy(), np.zeros(n)
        kept_paths: list[np.ndarray] = []
        for leaf in range(k):
            places = np.flatnonzero(edge_at >= 0)
            edges = edge_at[places].astype(np.int64)
            a, b = np.searchsorted(places, self.doc_start), np.searchsorted(places, self.doc_end)
            whole = np.zeros(n)
            some = a < b
            if some.any():  # each text by itself, so that its neighbours do not matter
                whole[some] = np.add.reduceat(lat.logp[edges], a[some])
            leaves.append({"doc": docs, "arrival": arrival, "logp": whole[docs], "places": places, "edges": edges, "first": a, "last": b})
            kept_paths.append(edge_at)
            at = np.searchsorted(places, begin[docs])
            new = self.alternatives(leaf, docs, at, b[docs], mass, whole[docs], arrival, places, edges, DEPTH, False)
            pool = new if pool is None else {c: np.concatenate([pool[c], new[c]]) for c in new}
            pool, popped = self.pop(pool, leaves, k - leaf)
            if leaf == k - 1 or not len(popped["doc"]):
                leaves.append({"doc": popped["doc"], "arrival": popped["arrival"], "bound": True})
                break
            docs, arrival, mass = popped["doc"], popped["arrival"], popped["mass"]
            edge_at = np.full(self.total, -1, np.int32)
            for source in np.unique(popped["leaf"]):  # the prefix comes from the leaf that was left
                own = popped["leaf"] == source
                d, q = popped["doc"][own], popped["place"][own]
                idx = bv.ranges(self.doc_start[d], q - self.doc_start[d])
                edge_at[idx] = kept_paths[source][idx]
            edge_at[popped["place"]] = popped["edge"]
            begin = self.doc_start.copy()
            begin[docs] = popped["place"] + lat.len[popped["edge"]]
            word = self.word_at(popped["place"])
            mid = begin[docs] < self.w_end[word]
            live = np.zeros(n, bool)
            live[docs] = True
            later = np.flatnonzero(live[self.w_doc] & (self.w_start >= begin[self.w_doc]))
            self.walk(leaf + 1, edge_at, np.concatenate([begin[docs][mid], self.w_start[later]]), np.concatenate([word[mid], later]))
        return leaves

    def pop(self, pool: dict, leaves: list[dict], want: int) -> tuple[dict, dict]:
        """Each document's first node, a prefix; nodes that stand for a deep rest are opened until it is one."""
        depth = DEPTH
        while True:
            order = np.lexsort((pool["arrival"], pool["doc"]))
            pool = {c: x[order] for c, x in pool.items()}
            doc = pool["doc"]
            first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            rank = np.arange(len(doc)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(doc))))
            keep = rank < max(want, 1) + 1
            rests = first & (pool["edge"] < 0)
            if not rests.any():
                popped = {c: x[first] for c, x in pool.items()}
                return {c: x[keep & ~first] for c, x in pool.items()}, popped
            depth *= 4
            opened = {c: x[rests] for c, x in pool.items()}
            pool = {c: x[~rests] for c, x in pool.items()}
            for source in np.unique(opened["leaf"]):
                own = {c: x[opened["leaf"] == source] for c, x in opened.items()}
                path = leaves[source]
                logp = np.zeros(self.n)
                logp[path["doc"]] = path["logp"]
                new = self.alternatives(int(source), own["doc"], own["token"], path["last"][own["doc"]], own["mass"], logp[own["doc"]], own["arrival"], path["places"], path["edges"], depth, True)
                pool = {c: np.concatenate([pool[c], new[c]]) for c in pool}

    def ids(self, edges: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's begin."""
        v = self.v
        piece = self.lattice.piece[edges].astype(np.int64)
        cp = piece - v.size
        width = np.where(cp >= 0, _n_bytes(np.maximum(cp, 0)), 1)
        at = np.concatenate([[0], np.cumsum(width)])
        ascii_ = (cp >= 0) & (cp < 128)
        piece[ascii_] = v.byte_id[cp[ascii_]]
        if (width > 1).any():
            out = np.repeat(piece, width)
            wide = np.flatnonzero(cp >= 128)
            for c in np.unique(cp[wide]):
                spell = v.byte_id[list(("▁" if c == LITERAL else chr(c)).encode())]
                where = at[wide[cp[wide] == c]]
                out[(where[:, None] + np.arange(len(spell))).ravel()] = np.tile(spell, len(where))
            piece = out
        return piece, np.concatenate([at[first], at[last[-1:]]])


FIELDS = [
    ("doc_id", pa.int64()), ("repetition", pa.int64()), ("sample", pa.int32()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
    ("log_inclusion", pa.float64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_()),
]
OUT = "doc_id long, repetition long, sample int, n_tokens long, log_prob double, perturbed double, log_inclusion double, ids array<int>, round_trip boolean"


def row_keys(doc_ids: list, seed: int, repetitions: list | None = None) -> np.ndarray:
    """What a row's draws depend on: the seed, its id (null has a key of its own) and the number of its repetition."""
    null = np.array([d is None for d in doc_ids], bool)
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64).view(np.uint64)
    keys = bv.mix((ids + np.uint64(1)) * bv.GOLD + np.uint64(seed))
    keys[null] = bv.mix(keys[null] ^ np.uint64(0x6E756C6C))
    if repetitions is not None:
        times = np.array([r or 0 for r in repetitions], np.int64).view(np.uint64)
        keys = np.where(times > 0, bv.mix(keys + times * np.uint64(0xD1342543DE82EF95)), keys)
    return keys


def encode_chunk(v: Vocabulary, doc_ids: list, texts: list[str], k: int, seed: int, repetitions: list | None = None):
    """Record batches for some texts, one for each sample."""
    keys = row_keys(doc_ids, seed, repetitions)
    walks = Walks(v, texts, keys)
    leaves = walks.sample(k)
    bound = np.full(len(texts), np.inf)  # log-time of the first arrival that isn't in the sample
    if leaves[-1].get("bound"):
        bound[leaves[-1]["doc"]] = leaves[-1]["arrival"]
    raw = [t.encode() for t in texts]
    for rank, leaf in enumerate(x for x in leaves if not x.get("bound")):
        tokens, start = walks.ids(leaf["edges"], leaf["first"], leaf["last"])
        spelled = v.decode(tokens)
        ends = np.concatenate([[0], np.cumsum(v.offsets[tokens + 1] - v.offsets[tokens])])[start]
        docs = leaf["doc"]
        with np.errstate(over="ignore", divide="ignore"):
            gap = leaf["logp"] + bound[docs]  # log-probability less the bound's perturbed log-probability
            small = np.exp(np.minimum(gap, 50.0))
            inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-small)))
        ok = [spelled[ends[d] : ends[d + 1]].tobytes()[1:] == raw[d] for d in docs]
        if not all(ok):
            raise RuntimeError("the ids of a segmentation do not spell its text")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((start[1:] - start[:-1])[docs])]).astype(np.int32)), pa.array(tokens[bv.ranges(start[docs], (start[1:] - start[:-1])[docs])].astype(np.int32)))
        cols = [pa.array([doc_ids[d] for d in docs], pa.int64()), pa.array([repetitions[d] or 0 if repetitions else 0 for d in docs], pa.int64()), pa.array(np.full(len(docs), rank + 1, np.int32)), pa.array((start[1:] - start[:-1])[docs]), *(pa.array(np.round(x, 9) + 0.0) for x in (leaf["logp"], -leaf["arrival"], inclusion)), lists, pa.array(ok, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(FIELDS))


def sample_encode(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str | None = None, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", repetition_col: str | None = None) -> DataFrame:
    """k distinct segmentations per row, sampled without replacement: one row each, in order of arrival.

    ``log_prob``: of the segmentation; ``perturbed``: with its Gumbel noise; ``log_inclusion``: logarithm
    of the probability that the segmentation beats the best one left out, for weighted estimates;
    ``round_trip``: the ids decode to the text (anything else is an error, so it is true). A text with fewer than k segmentations gives all of them,
    with inclusion 1; null and empty texts have one, of no tokens. Rows with a null id share a key of their
    own; rows of equal id and text get equal samples, unless ``repetition_col`` numbers them (see
    ``repetitions``), which is then part of the key. Whole texts, of any length, are walked, at some 110 bytes
    of memory a character. Nothing is shuffled; the model's path must be readable on every executor.
    """
    path = model or default_model()

    def run(batches):
        v = vocabulary(path, power)
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1).to_pylist()
            again = batch.column(2).to_pylist() if repetition_col else None
            lo, size = 0, 0
            for i, t in enumerate(texts):
                texts[i] = t or ""
                size += len(texts[i])
                if size > CHUNK or i == len(texts) - 1:
                    yield from encode_chunk(v, ids[lo : i + 1], texts[lo : i + 1], k, seed, again and again[lo : i + 1])
                    lo, size = i + 1, 0

    more = [F.col(repetition_col).cast("long")] if repetition_col else []
    return docs.select(id_col, text_col, *more).mapInArrow(run, OUT)


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "repetition", task_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with the number (from 0) of each row among those of equal id and text, so that each can be sampled anew.

    One shuffle by id and text, to tasks of about ``task_bytes`` of text. Rows of equal id and text are numbered
    in any order: they differ in nothing that is encoded.
    """
    if name in docs.columns:
        raise ValueError(f"the table has a column {name!r} already")
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.col(id_col), text).alias("same"))
    w = Window.partitionBy("same").orderBy("same")
    dealt = own.repartition(max(1, -(-total // task_bytes)), "same").withColumn("number", F.row_number().over(w) - 1)
    return dealt.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("number").alias(name))


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add the text that each row's ids spell; null ids give a null text, and bytes that are no UTF-8 become U+FFFD."""
    path = model or default_model()
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        v = vocabulary(path, POWER)
        for batch in batches:
            texts = [None if x is None else v.decode(np.array(x, np.int64)).tobytes()[1:].decode(errors="replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_encode(documents(spark, sf_dir))


QUERIES = {"op1_sentencepiece": op1}
ORACLES: dict[str, str] = {}

"""Secret scans: fixed shapes, and strings that a tokenizer finds unusually expensive.

Natural words and code names fall into long tokens, random strings into short ones. A run of key-like
characters that mixes letters and digits, or has capitals inside, and has few characters per token is
reported, unless it is a digest of usual length, an identifier of a known form or made of plain words, or
overlaps a span found by shape. The regular expressions see the whole text as bytes and take time in
proportion to it; the tokenizer sees only the runs that could be keys. Runs of letters in one case are not
judged: long words of languages that the vocabulary knows little of are as expensive as random ones.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import documents

#: Kinds in the order in which equal starts are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: Words that an assignment must name, to leave most texts alone: each keyword holds one of these.
HINTS = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)
#: Characters of a run that is judged, at least: as many as the value of an assignment has.
LEAST = 12
#: What a run must mix: letters and a digit, or letters of both cases with a capital after the first character.
MIXED = re.compile(rb"(?=.*[A-Za-z])(?=.*\d)|(?=.*[a-z]).+[A-Z]")
#: Characters a token below which a run counts as random.
RATIO = 2.3
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: Fixed forms of identifiers.
KNOWN = re.compile(
    rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    rb"|\d[\d+/_=TZ-]*"  # numbers, dates and times, phone and card numbers
)
#: Forms of names. Random strings take them too, so a name's words must be cheap under the tokenizer as well.
NAME = re.compile(
    rb"[A-Za-z]+([_/-][A-Za-z]+)*[_/-]?\d{0,6}"  # words joined by marks, with a number at the end
    rb"|(?:[A-Z]?[a-z]++\d{0,3}+[_/-]?+)++"  # camel case; possessive, since nested repeats would try all ways to cut a word
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def shapes(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed shapes, in bytes."""
    found = []
    if HINTS.search(text):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


@lru_cache(8)
def _runs(least: int) -> re.Pattern:
    return re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % least)


def random_runs(text: bytes, base: list[tuple[int, int, int]], enc, ratio: float = RATIO, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Spans of runs with few characters a token that overlap no span of ``base`` (in order of starts)."""
    found, k, upto = [], 0, 0
    for m in _runs(least).finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] < b:  # the furthest end of the spans that start before this run's end
            upto = max(upto, base[k][1])
            k += 1
        run = m[0]
        if upto > a or not MIXED.match(run) or KNOWN.fullmatch(run):
            continue
        if len(run) in DIGESTS and re.fullmatch(rb"[0-9a-fA-F]+", run):
            continue
        said = run.decode()
        if len(said) < ratio * len(enc.encode_ordinary(said)) and not (NAME.fullmatch(run) and _cheap(WORDS.findall(said), enc, ratio)):
            found.append((a, b, 3))
    return found


def _cheap(words: list[str], enc, ratio: float) -> bool:
    """Whether words, each by itself, have at least ``ratio`` characters a token."""
    return sum(map(len, words)) >= ratio * sum(len(enc.encode_ordinary(w)) for w in words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans.

    ``spans`` lists kind:start:end in code points, by start, then kind as in ``KINDS``; ``base_sha256``
    digests the same list without the method's spans. The method judges runs of ``least`` characters and
    more that have under ``ratio`` characters a token. Letters of assignments match in either ASCII case.
    Null text is empty and has no spans; ids are carried as they are, null or repeated. Whole texts of any
    length are read; nothing is shuffled, and no secret leaves in the result.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoding(path)
        for b in batches:
            rows = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                base = shapes(text)
                spans = sorted(base + random_runs(text, base, enc, ratio, least), key=lambda s: (s[0], s[2]))
                place = _code_points(text, sorted({x for s in spans for x in s[:2]}))
                say = lambda some: ",".join(f"{KINDS[k]}:{place[a]}:{place[z]}" for a, z, k in some)  # noqa: B023, E731
                counts = [sum(s[2] == k for s in spans) for k in range(4)]
                rows.append((*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def _code_points(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets as code points."""
    if not offsets:
        return {}
    tails = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80) if not text.isascii() else ()
    return {o: o - bisect.bisect_left(tails, o) for o in offsets}


def redact(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``docs`` with every span found in ``text_col`` replaced by ``[kind]``; overlapping spans become one, named by the first."""
    path = vocabulary or default_vocabulary()
    at = docs.columns.index(text_col)

    def run(batches):
        enc = encoding(path)
        for b in batches:
            out = []
            for text in b.column(at).cast(pa.binary()).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                base = shapes(text)
                parts, end = [], 0
                for a, z, k in sorted(base + random_runs(text, base, enc, ratio, least)):
                    if a >= end:
                        parts += [text[end:a], f"[{KINDS[k]}]".encode()]
                    end = max(end, z)
                out.append(b"".join([*parts, text[end:]]).decode(errors="replace"))
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their secrets, by digest and size."""
    out = redact(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op8_secret_scan": op8, "redacted_documents": redacted_documents}
ORACLES: dict[str, str] = {}

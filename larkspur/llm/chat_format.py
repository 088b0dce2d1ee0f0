"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Running sums of the turns' tokens decide where a window
ends: it takes new turns while the budget holds them beside the system turn, which every window keeps,
and a limited number of tokens of the turns before, which are repeated as context. Loss is on the text of
assistant turns where they are new, so each trains once.

Turns are written as ``### role``, a line end, the text, ``</turn>`` and a line end. Inside a text every
backslash is doubled, and ``##`` and ``</turn>`` get a backslash inside, so neither ``###`` nor ``</turn>``
can stand in a text and reading back is exact.

Rows of a conversation reach one task in order and are streamed: the task holds a window's turns and no
more, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.secret_scan import default_vocabulary, encoding

#: Tokens in a window, and among them repeated ones at most (the system turn apart).
BUDGET = 1024
HISTORY = 192
END = "</turn>\n"
_PLAIN = re.compile(r"[A-Za-z_]+")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text lies in it."""
    head = f"### {role if _PLAIN.fullmatch(role) else json.dumps(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        role = formatted[at + 4 : line]
        end = formatted.index(END, line + 1)
        turns.append((json.loads(role) if role.startswith('"') else role, unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return turns


class Windower:
    """Windows of one conversation, from its turns in order."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.context: list[tuple] = []  # repeated turns: (rendered, lo, hi, role, tokens)
        self.new: list[tuple] = []
        self.sums = [0]  # of the new turns' tokens
        self.number = 0

    def _fixed(self) -> int:
        return (self.system[4] if self.system and self.number else 0) + sum(t[4] for t in self.context)

    def add(self, turn: tuple) -> Iterator[tuple]:
        if self.new and self._fixed() + self.sums[-1] + turn[4] > self.budget:
            yield self.close()
            keep, room = [], min(self.history, self.budget - turn[4] - (self.system[4] if self.system else 0))
            for t in reversed([*self.context, *self.new]):
                if t is self.system or t[4] > room:
                    break
                room -= t[4]
                keep.insert(0, t)
            self.context, self.new, self.sums, self.number = keep, [], [0], self.number + 1
        if self.number == 0 and not self.new and turn[3] == "system":
            self.system = turn
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[4])

    def close(self) -> tuple:
        """(number, turns repeated, text, loss spans, tokens)."""
        repeated = ([self.system] if self.system and self.number else []) + self.context
        parts, spans, at = [], [], 0
        for k, (text, lo, hi, role, _) in enumerate([*repeated, *self.new]):
            if k >= len(repeated) and role == "assistant":
                spans.append((at + lo, at + hi))
            parts.append(text)
            at += len(text)
        return self.number, len(repeated), "".join(parts), spans, self._fixed() + self.sums[-1]


SPAN = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
WINDOW = "conv_id long, window long, n_repeated long, formatted string, loss array<struct<lo: long, hi: long>>, n_tokens long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, number, repeated, text, spans, tokens = zip(*rows)
    loss = pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], pa.list_(SPAN))
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(number, pa.int64()), pa.array(repeated, pa.int64()), pa.array(text, pa.string()), loss, pa.array(tokens, pa.int64())], names=["conv_id", "window", "n_repeated", "formatted", "loss", "n_tokens"])


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, n_repeated (turns at its head that are context), formatted, loss (code point spans), n_tokens.

    Needs conv_id, turn, role, text; other columns are ignored. Turns go by ``turn`` (null first), ties by
    role and text, and repeated rows are turns of their own. Null texts and roles are empty; rows with a
    null conv_id are one conversation. A turn larger than the budget makes a window of its own with the
    system turn and no history. Windows of a conversation follow one another within a partition. An empty
    table gives no windows.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoding(path)
        now, windower, rows, size = object(), None, [], 0
        for b in batches:
            convs, roles, texts = (b.column(k).to_pylist() for k in range(3))
            for conv, role, text in zip(convs, roles, texts):
                made = []
                if windower is None or conv != now:
                    if windower is not None:
                        made.append((now, *windower.close()))
                    now, windower = conv, Windower(budget, history)
                shown, lo, hi = render(role, text)
                made += [(now, *w) for w in windower.add((shown, lo, hi, role, len(enc.encode_ordinary(shown))))]
                rows += made
                size += sum(len(r[3]) for r in made)
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if windower is not None:
            rows.append((now, *windower.close()))
            yield _batch(rows)

    empty = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    ``windows`` must come in the order in which ``format_windows`` gives them.
    """

    def run(batches):
        now, state, rows = None, None, []

        def done():
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for b in batches:
            for w in b.to_pylist():
                if state is None or w["conv_id"] != now:
                    if state is not None:
                        done()
                    now, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = w["formatted"]
                for role, said in parse(text)[w["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in w["loss"]:
                    said = unescape(text[span["lo"] : span["hi"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
            if len(rows) > 10_000:
                yield _digests(rows)
                rows = []
        if state is not None:
            done()
            yield _digests(rows)

    def _digests(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings."""
    trap = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(table.unionByName(more)))


QUERIES = {"op3_chat_format": op3}
ORACLES: dict[str, str] = {}

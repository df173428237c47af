r"""Chat formatting in budgeted windows.

Each turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside
roles and texts are broken up by backslashes, and backslashes are doubled, so that a
written conversation can always be read back. A conversation becomes one or more windows
of at most BUDGET tokens (words and control strings), cut between turns: prefix sums of
the turns' tokens give the longest span that fits. Every window but the first begins with
the system turn, if the conversation starts with one, and with up to HISTORY_TURNS of the
turns just before its span as long as they take at most HISTORY_SHARE of the budget. The
loss mask of a window covers the texts of its span's assistant turns; repeated turns are
masked out, so that over all windows each assistant text is a target once, in order.
A turn that is longer than the budget is never cut and gets a window of its own.

Turns are streamed in order through a task, which holds one window's turns at a time, so
a conversation may have any number of turns.

Defined results for odd rows: a null text is an empty text, a null role an empty role;
turns with equal numbers are ordered by role and text, null turn numbers come first; rows
with a null conv_id are one conversation; a conversation that is a system turn alone has
one window; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_SHARE = 0.25
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates, none of which may stand in a text.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)
_TOKEN = re.compile(r"\S+")
#: Words of the template around a turn.
TURN_COST = 2


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def cost(text: str) -> int:
    """Tokens of a turn as it is written."""
    return TURN_COST + sum(1 for _ in _TOKEN.finditer(text))


class Writer:
    """Takes a conversation's turns one by one and gives its windows as they fill.

    A window is (text, n_context, mask): n_context turns at its front repeat earlier ones,
    mask lists [start, end) of targets in its text, in code points."""

    def __init__(self, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE):
        self.budget, self.history_turns, self.history = budget, history_turns, int(budget * history_share)
        self.system: tuple[str, str, int] | None = None
        self.context: list[tuple[str, str, int]] = []
        self.span: list[tuple[str, str, int]] = []
        self.used = 0  # the prefix sum of the tokens of system turn, context and span
        self.n_turns = 0

    def add(self, role: str, text: str) -> Iterator[tuple[str, int, list[int]]]:
        turn = (role, text, cost(text))
        if self.used + turn[2] > self.budget and self.span:
            yield self.finish()
            self._begin(turn[2])
        if self.n_turns == 0 and role == "system":
            self.system = turn
        self.n_turns += 1
        self.span.append(turn)
        self.used += turn[2]

    def _begin(self, coming: int) -> None:
        """Starts a window: the system turn and what history leaves room for the coming turn."""
        latest, self.context, self.span = (self.context + self.span)[-self.history_turns :] if self.history_turns else [], [], []
        self.used = self.system[2] if self.system else 0
        room = min(self.history, self.budget - self.used - coming)
        for turn in reversed(latest):
            if turn is self.system or turn[2] > room:
                break
            room -= turn[2]
            self.context.insert(0, turn)
            self.used += turn[2]
        if self.system:
            self.context.insert(0, self.system)

    def finish(self) -> tuple[str, int, list[int]]:
        parts, at, mask = [], 0, []
        for k, (role, text, _) in enumerate(self.context + self.span):
            head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
            if role == "assistant" and k >= len(self.context):
                mask += [at + len(head), at + len(head) + len(body)]
            parts += [head, body, f"{CLOSE}\n"]
            at += len(head) + len(body) + len(CLOSE) + 1
        return "".join(parts), len(self.context), mask


def read_window(text: str) -> list[tuple[str, str]]:
    """The turns that a window's text holds."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


def format_conversations(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE) -> DataFrame:
    """(conv_id, window, text, n_context, mask), a conversation's windows in order in one partition."""
    rows = bounded_batches(turns).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, n, out, size = None, None, 0, [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.int32()), pa.array([x[4] for x in out], pa.list_(pa.int32()))],
                names=["conv_id", "window", "text", "n_context", "mask"],
            )

        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if writer is None or conv != now:
                    if writer is not None:
                        out.append((now, n, *writer.finish()))
                    now, writer, n = conv, Writer(budget, history_turns, history_share), 0
                for window in writer.add(role, text):
                    out.append((now, n, *window))
                    n += 1
                size += len(text)
                if size > 4 << 20:
                    yield batch()
                    out, size = [], 0
        if writer is not None:
            out.append((now, n, *writer.finish()))
        yield batch()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, window long, text string, n_context int, mask array<int>")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows of each conversation hold, as the contract has them. Takes
    the windows as `format_conversations` leaves them; nothing but their text, context
    length and mask is used."""

    def run(batches):
        now, state, out = None, None, []

        def end():
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, text, n_context, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "n_context", "mask"))):
                if state is None or conv != now:
                    if state is not None:
                        end()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_window(text)[n_context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, z in zip(mask[::2], mask[1::2]):
                    target = unescape(text[a:z])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
        if state is not None:
            end()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all conversations and conversation -1."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(extra)))


def brute_force(turns: list[tuple]) -> dict:
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256) from the rows themselves; for tests."""
    out: dict = {}
    for conv, turn, role, text in sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in turns), key=lambda x: x[1:]):
        out.setdefault(conv, []).append((role, text))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in v if r == "assistant") for c, v in out.items()}
    return {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss[c]), sha(loss[c])) for c, v in out.items()}

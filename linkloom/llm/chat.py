"""Chat formatting in budgeted windows.

A conversation's turns become windows of at most `budget` tokens that begin and end at turns.
Prefix sums of turn tokens choose each span: the leading system turn, up to `history` tokens of
turns that an earlier window held, then new turns. Only assistant turns that are new carry loss,
so every assistant text is learned once. Tokens are those of the rendered turn, with role, marks
and escapes; as a turn ends in a line break and the next begins with "###", no pre-token spans
two turns and a window's tokens are the sum of its turns'.

Template: "### Role: text </turn>\\n". A backslash goes before every backslash, "###" and
"</turn>" inside roles and texts, which undoes itself exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SharedTokenizer

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "### ", " </turn>\n"
_escape = re.compile(r"\\|###|</turn>").sub
_unescape = re.compile(r"\\(.)", re.DOTALL).sub
#: Role up to an unescaped colon, then text up to an unescaped end mark.
_turn = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\ ]++|\\.| (?!</turn>\n))*+) </turn>\n", re.DOTALL)
WINDOW = "conv_id long, window int, n_repeated int, text string, loss array<struct<start:int,stop:int>>"


def escape(s: str) -> str:
    return _escape(lambda m: "\\" + m.group(), s)


def escape_role(s: str) -> str:
    return escape(s).replace(":", "\\:")


def unescape(s: str) -> str:
    return _unescape(r"\1", s)


def parts(role: str, text: str) -> tuple[str, str]:
    """A rendered turn up to its text, and its escaped text; CLOSE follows."""
    return f"{OPEN}{escape_role(role)}: ", escape(text)


def render(turns: list[tuple[str, str]], first_new: int) -> tuple[str, list[dict]]:
    """The text of a window and its loss spans; turns before first_new are repeated ones."""
    out, loss, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = parts(role, text)
        if role == "assistant" and i >= first_new:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), loss


class Windows:
    """Windows of one conversation whose turns come one by one; holds a window at most."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv, self.budget, self.history = conv_id, budget, history
        self.system: list[tuple[tuple[str, str], int]] = []
        self.old: list[tuple[tuple[str, str], int]] = []
        self.new: list[tuple[tuple[str, str], int]] = []
        self.sums, self.number, self.begun, self.retained = [0], 0, False, True

    def _kept(self) -> list[tuple[tuple[str, str], int]]:
        """The system turn, where this window repeats it."""
        return self.system if self.number and self.retained else []

    def _close(self) -> tuple:
        again = self._kept() + self.old
        text, loss = render([t for t, _ in again + self.new], len(again))
        row = (self.conv, self.number, len(again), text, loss)
        self.number += 1
        # Prefix sums over what this window held: the longest tail within the history budget.
        tail = [t for t in self.old + self.new if not self.system or t is not self.system[0]]
        sums = [0]
        for _, n in reversed(tail):
            if sums[-1] + n > self.history:
                break
            sums.append(sums[-1] + n)
        self.old, self.new, self.sums, self.retained = tail[len(tail) - len(sums) + 1 :], [], [0], True
        return row

    def _used(self) -> int:
        return sum(n for _, n in self._kept() + self.old) + self.sums[-1]

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = ((role, text), tokens)
        if self.new and self._used() + tokens > self.budget:
            yield self._close()
        if not self.new:  # history gives way to a new turn, then the system turn does
            while self.old and self._used() + tokens > self.budget:
                self.old.pop(0)
            self.retained = self._used() + tokens <= self.budget
        if not self.begun and role == "system":
            self.system = [turn]
        self.begun = True
        self.new.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def end(self) -> Iterator[tuple]:
        if self.new:
            yield self._close()


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "window", "n_repeated", "text", "loss"])


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Windows (conv_id, window, n_repeated, text, loss) of turns (conv_id, turn, role, text).

    Rows are taken by turn, then role and text (ties, repeated rows: each a turn; null turn
    first). Null text and role count as empty. Null conv_ids are one conversation. No window of
    several turns has over `budget` tokens. A turn is never cut: one over the budget has a window
    of its own; one that doesn't fit beside the system turn has none beside it. Only a leading
    system turn is retained. An empty table gives no windows; other columns are not carried.

    Rows stream through a task sorted, so a conversation of any length needs the memory of a
    window. One conversation is one task's: where its windows begin depends on all turns before.
    """
    tokenizer = SharedTokenizer(turns.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now, rows, size = tokenizer(), None, [], 0
        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv != now.conv:
                    rows += now.end() if now else ()
                    now = Windows(conv, budget, history)
                head, body = parts(role, text)
                for row in now.add(role, text, sum(map(len, t.pieces(head + body + CLOSE)))):
                    rows.append(row)
                    size += len(row[3])
                if len(rows) >= 2000 or size > 8 << 20:
                    yield _window_batch(rows)
                    rows, size = [], 0
        yield _window_batch(rows + list(now.end() if now else ()))

    chosen = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def read_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read from its windows: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows. Repeated turns are skipped; a loss span in one, or a
    text that isn't the template's, is an error."""

    def row(conv: int | None, n: int, turns, loss, chars: int, formatted: int, count: int) -> tuple:  # noqa: ANN001
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state = None
        for b in batches:
            done = []
            for conv, again, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n_repeated", "text", "loss"))):
                if state is None or state[0] != conv:
                    done += [row(*state)] if state else []
                    state = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                at = new_from = 0
                for i, m in enumerate(_turn.finditer(text)):
                    if m.start() != at:
                        break
                    at = m.end()
                    if i < again:
                        new_from = at
                    else:
                        state[1] += 1
                        state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text) or any(s["start"] < new_from for s in loss):
                    raise ValueError(f"a window of conversation {conv} can't be read back")
                for s in loss:
                    learned = unescape(text[s["start"] : s["stop"]])
                    state[3].update(learned.encode())
                    state[4] += len(learned)
                state[5] += len(text)
                state[6] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 7, kinds)], names)
        done = [row(*state)] if state else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 7, kinds)], names)

    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

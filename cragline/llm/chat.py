"""Chat formatting by token-level assembly.

Every turn's strings are encoded separately into ordinary ids; reserved ids, which no text can produce, are spliced
in between; the loss mask is the prefix sum of +1 and -1 at the borders of trained segments. Control strings inside
a text are escaped before encoding (a backslash after their first character, backslashes doubled), so the formatted
text can be read back too.

Template: user `<s>[INST]text[/INST]`, assistant `text</s>`, any other role `[ROLE]role[/ROLE]text</s>`.

Defined results: null texts and roles are empty; equal turns of a conversation follow role and text; rows with a null
conv_id form one conversation. One turn is one row, so a conversation of any length is never held in memory; its
digest reads the turns in order.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import load_spec
from .common import pieces

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
BOS, EOS, INST, INST_END, ROLE, ROLE_END = range(6)
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Assembler:
    """Encodes turns with the ordinary ids of a rank file; reserved ids follow the last of them."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.base = max(table.values()) + 1

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, loss mask and offsets of (role, text) turns."""
        segments: list[tuple[str | int, bool]] = []
        turn_of: list[int] = []
        for k, (role, text) in enumerate(turns):
            if role == "user":
                new = [(BOS, False), (INST, False), (text, False), (INST_END, False)]
            elif role == "assistant":
                new = [(text, True), (EOS, False)]
            else:
                new = [(ROLE, False), (role, False), (ROLE_END, False), (text, False), (EOS, False)]
            segments += new
            turn_of += [k] * len(new)
        texts = iter(self.enc.encode_ordinary_batch([escape(s) for s, _ in segments if isinstance(s, str)], num_threads=1))
        parts = [next(texts) if isinstance(s, str) else [self.base + s] for s, _ in segments]
        size = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(size)
        ids = np.fromiter((i for p in parts for i in p), np.int32, int(size.sum()))
        step = np.zeros(len(ids) + 1, np.int32)
        loss = np.array([x for _, x in segments], bool)
        np.add.at(step, (ends - size)[loss], 1)
        np.add.at(step, ends[loss], -1)
        mask = np.cumsum(step[:-1]) > 0
        offs = np.r_[0, ends[np.r_[np.flatnonzero(np.diff(turn_of)), len(turn_of) - 1]]] if turn_of else np.zeros(1, np.int64)
        return ids, mask, offs

    def render(self, ids: list[int]) -> str:
        """The formatted text of ids."""
        return "".join(CONTROL[p - self.base] if isinstance(p, int) else self.enc.decode(p) for p in self._runs(ids))

    def _runs(self, ids):
        run: list[int] = []
        for i in ids:
            if i >= self.base:
                if run:
                    yield run
                    run = []
                yield int(i)
            else:
                run.append(int(i))
        if run:
            yield run

    def parse(self, ids: list[int], mask: list[bool]) -> tuple[str, str, str, int]:
        """(role, text, text under the loss mask, formatted characters) of one turn's ids."""
        text = lambda x: unescape(self.enc.decode(x))
        reserved = [(k, i - self.base) for k, i in enumerate(ids) if i >= self.base]
        if reserved[0][1] == BOS:
            role, body = "user", ids[2:-1]
        elif reserved[0][1] == ROLE:
            at = next(k for k, i in reserved if i == ROLE_END)
            role, body = text(ids[1:at]), ids[at + 1 : -1]
        else:
            role, body = "assistant", ids[:-1]
        return role, text(body), text([i for i, m in zip(ids, mask, strict=True) if m]), len(self.render(ids))


def format_turns(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, ids, loss: the assembled ids of each turn row (conv_id, turn, role, text) and their loss mask."""
    ranks = rows.sparkSession.sparkContext.broadcast(load_spec(path))

    def run(batches):
        a = None
        for b in pieces(batches, "text", 1 << 20):
            a = a or Assembler(ranks.value, pattern)
            turns = [(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            ids, mask, offs = a.assemble(turns)
            o = pa.array(offs, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.ListArray.from_arrays(o, pa.array(ids)), pa.ListArray.from_arrays(o, pa.array(mask))], names=["conv_id", "turn", "ids", "loss"])

    return rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text").mapInArrow(run, "conv_id long, turn long, ids array<int>, loss array<boolean>")


def read_turns(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text, loss_text, chars: the turns read back from assembled ids."""
    ranks = formatted.sparkSession.sparkContext.broadcast(load_spec(path))

    def run(batches):
        a = None
        for b in batches:
            a = a or Assembler(ranks.value, pattern)
            got = [a.parse(i, m) for i, m in zip(b.column("ids").to_pylist(), b.column("loss").to_pylist(), strict=True)]
            role, text, loss, chars = map(list, zip(*got, strict=True)) if got else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "turn", "role", "text", "loss_text", "chars"])

    return formatted.mapInArrow(run, "conv_id long, turn long, role string, text string, loss_text string, chars long")


def digest(turns: DataFrame) -> DataFrame:
    """One row a conversation; a task streams its sorted turns and keeps hash states only."""

    def run(batches):
        key, state = None, None
        out: list[tuple] = []
        for b in batches:
            for conv, role, text, loss, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "chars")), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if len(out) >= 5000:
                yield _rows(out)
                out = []
        if state is not None:
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if out:
            yield _rows(out)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

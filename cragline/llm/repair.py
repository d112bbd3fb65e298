"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

Backward cost-to-go over turns and four grammar states (start, after system, after user, after assistant), then a
greedy walk forward that takes the ASCII-least edit among those that keep the cost: D(elete), I(nsert), K(eep),
R(erole). From the edits the turns are rebuilt.

A conversation of any length is cut: its sorted rows lie in range partitions, each of which makes chunks of at most
ROWS rows. A whole conversation in one chunk is settled there. For the others each chunk is summed up as its 4 x 4
costs from state to state; a backward pass over these few numbers gives each chunk the costs behind it, and the chunks
are then walked in order, in constant memory. Equal rows of a turn are one row with a count before anything is sorted.

Defined results: rows follow turn (nulls first), role, text; a null conv_id is a conversation; null roles and texts are
one space; repeated rows are duplicates of the first; a conversation without rows has zeros, no edits, no turns; an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch

ROWS = 512
CHARS = 1 << 20
BLANK = " \t\n\x0b\x0c\r"
#: By state: the role that an inserted or reroled turn has there, and the state after it.
NEED = ("user", "user", "assistant", "user")
TO = (2, 2, 3, 2)
#: What is still to insert behind the last row.
TAIL = (0, 10, 5, 0)
FAR = 1 << 60

CHUNK = "cn boolean, cv long, part int, k long, whole boolean, turns array<long>, initials array<string>, faults array<string>, copies array<long>, roles array<string>, texts array<string>, costs array<long>"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of `conv_id:turn`: n is 0 for a dropped row, 2 for a repeated one."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, with its fault: b(lank), d(uplicate), t(runcated) or none; sorted in range partitions."""
    clean = rows.select(
        F.col("conv_id").isNull().alias("cn"), F.coalesce("conv_id", F.lit(0)).alias("cv"), F.col("turn").isNotNull().alias("tn"), F.coalesce("turn", F.lit(0)).alias("tv"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n",
    )
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key")
    here = clean.withColumn("key", F.when(F.col("n") > 0, key).otherwise("")).groupBy("cn", "cv", "tn", "tv", "key").agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("n").alias("n"))
    first = here.filter("n > 0").groupBy("cn", "cv", "key").agg(F.min(F.struct("tn", "tv")).alias("t")).select("cn", "cv", "t.tn", "t.tv", "key", F.lit(True).alias("first"))
    met = here.join(first, ["cn", "cv", "tn", "tv", "key"], "left")
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(end == "", "b").when(F.col("first").isNull(), "d").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    marked = met.withColumn("fault", F.when(F.col("n") > 0, fault).otherwise(""))
    order = ["cn", "cv", "tn", "tv", "role", "text"]
    return marked.withColumn("initial", F.left("role", F.lit(1))).repartitionByRange(*order).sortWithinPartitions(*order)


def to_go(codes: list[tuple], end: tuple) -> list[tuple]:
    """Costs to go before each row and behind the last, by state; codes are (initial, fault, copies), end is known."""
    out = [end]
    a0, a1, a2, a3 = end
    for initial, fault, n in reversed(codes):
        b0, b1, b2, b3 = a0 + 2, a1 + 2, a2 + 2, a3 + 2
        if fault in ("", "t"):
            bad = 5 if fault else 0
            user, assistant = a2 + bad + (initial != "u"), a3 + bad + (initial != "a")
            b0, b1, b2, b3 = min(b0, user), min(b1, user), min(b2, assistant), min(b3, user)
            if initial == "s":
                b0 = min(b0, a1 + bad)
        b2, b3 = min(b2, b3 + 5), min(b3, b2 + 5)
        more = 2 * (n - 1)  # further copies are duplicates
        a0, a1, a2, a3 = min(b0, b2 + 5) + more, min(b1, b2 + 5) + more, b2 + more, b3 + more
        out.append((a0, a1, a2, a3))
    return out[::-1]


def walk(codes: list[tuple], table: list[tuple], state: int) -> tuple[str, list[tuple[int, str]], int]:
    """(edits, turns as (row or -1, role or empty for the row's own), state behind) of the ASCII-least cheapest way."""
    edits: list[str] = []
    turns: list[tuple[int, str]] = []
    for i, (initial, fault, n) in enumerate(codes):
        more = 2 * (n - 1)
        while True:
            now, then, to = table[i][state], table[i + 1], TO[state]
            if then[state] + 2 + more == now:
                edits.append("D")
                break
            if table[i][to] + 5 == now:
                edits.append("I")
                turns.append((-1, NEED[state]))
                state = to
                continue
            bad = 5 if fault else 0
            if state == 0 and initial == "s" and then[1] + bad + more == now:
                edits.append("K")
                turns.append((i, ""))
                state = 1
            elif initial == NEED[state][0]:
                edits.append("K")
                turns.append((i, ""))
                state = to
            else:
                edits.append("R")
                turns.append((i, NEED[state]))
                state = to
            break
        edits.append("D" * (n - 1))
    return "".join(edits), turns, state


def _cut(lengths: list[int], new: list[bool]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are chunks."""
    a = chars = 0
    for i, (size, starts) in enumerate(zip(lengths, new, strict=True)):
        if i > a and (starts or i - a >= ROWS or chars >= CHARS):
            yield a, i
            a, chars = i, 0
        chars += size
    if lengths:
        yield a, len(lengths)


def _chunks(batches):
    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        col = {c: b.column(c).to_pylist() for c in ("cn", "cv", "tn", "tv", "n", "initial", "fault", "role", "text")}
        conv = list(zip(col["cn"], col["cv"], strict=True))
        new = [True, *(x != y for x, y in zip(conv[1:], conv[:-1], strict=True))] if conv else []
        cuts = list(_cut([len(t) for t in col["text"]], new))
        out = []
        for a, z in cuts:
            live = [i for i in range(a, z) if col["n"][i] > 0]
            # a conversation that may go on in another batch or chunk is not whole
            whole = a > 0 and new[a] and z < len(conv) and new[z]
            codes = [(col["initial"][i], col["fault"][i], col["n"][i]) for i in live]
            costs = [] if whole else [c for e in range(4) for c in to_go(codes, tuple(0 if s == e else FAR for s in range(4)))[0]]
            row = {"cn": conv[a][0], "cv": conv[a][1], "part": part, "k": k, "whole": whole, "turns": [col["tv"][i] if col["tn"][i] else None for i in live], "copies": [col["n"][i] for i in live], "costs": costs}
            row |= {"initials": [col["initial"][i] for i in live], "faults": [col["fault"][i] for i in live], "roles": [col["role"][i] for i in live], "texts": ["" if col["fault"][i] in ("b", "d") else col["text"][i] for i in live]}
            out.append(row)
            k += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, _CHUNK_ARROW)


_text = pa.list_(pa.string())
_CHUNK_ARROW = pa.schema([("cn", pa.bool_()), ("cv", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("initials", _text), ("faults", _text), ("copies", pa.list_(pa.int64())), ("roles", _text), ("texts", _text), ("costs", pa.list_(pa.int64()))])


class Tally:
    """What is known of a conversation as its chunks come by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.low = self.high = self.last_turn = self.initial = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.state = self.place = 0
        self.started = False
        self.audit: list[str] = []
        self.sha = hashlib.sha256()

    def add(self, chunk: dict, end: tuple) -> Iterator[tuple]:
        """Counts and edits of the next chunk, with the costs to go behind it; gives its rebuilt turns."""
        codes = list(zip(chunk["initials"], chunk["faults"], chunk["copies"], strict=True))
        for turn, (initial, fault, n) in zip(chunk["turns"], codes, strict=True):
            if turn is not None:
                self.distinct += turn != self.last_turn
                self.last_turn = self.high = turn
                self.low = turn if self.low is None else self.low
            self.blank += n if fault == "b" else 0
            self.duplicate += n if fault == "d" else 0 if fault == "b" else n - 1
            self.truncated += fault == "t"
            self.illegal += n - 1 + (self.initial is not None and (self.initial, initial) not in (("s", "u"), ("u", "a"), ("a", "u")))
            self.initial = initial
        table = to_go(codes, end)
        if not self.started:
            self.cost, self.started = table[0][0], True
        edits, turns, self.state = walk(codes, table, self.state)
        self.audit.append(edits)
        yield from self._turns((role or chunk["roles"][i], chunk["texts"][i] if i >= 0 else "") for i, role in turns)

    def _turns(self, turns) -> Iterator[tuple]:
        for role, text in turns:
            self.sha.update((f"{role}:{text}" if not self.place else f"\n{role}:{text}").encode())
            yield self.conv_id, self.place, role, text
            self.place += 1

    def close(self) -> Iterator[tuple]:
        """The turns inserted behind the last row."""
        while TAIL[self.state]:
            role, self.state = NEED[self.state], TO[self.state]
            self.audit.append("I")
            yield from self._turns([(role, "")])

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _finish(report: bool):
    """Walks chunks that come in order; a conversation's chunks lie together."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())] if report else [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def rows(batches) -> Iterator[tuple]:
        tally, key = None, None

        def out(turns):
            """Turns as rows, or hashed only."""
            for row in turns:
                if not report:
                    yield row

        def done():
            yield from out(tally.close())
            if report:
                yield tally.report()

        for b in batches:
            for i in range(b.num_rows):
                chunk = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if tally is None or (chunk["cn"], chunk["cv"]) != key:
                    if tally is not None:
                        yield from done()
                    key = (chunk["cn"], chunk["cv"])
                    tally = Tally(None if chunk["cn"] else chunk["cv"])
                yield from out(tally.add(chunk, tuple(chunk["behind"] or TAIL)))
        if tally is not None:
            yield from done()

    def run(batches):
        held: list[tuple] = []
        size = 0
        for row in rows(batches):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str))
            if size >= 4 << 20:
                yield _record(held, schema)
                held, size = [], 0
        if held:
            yield _record(held, schema)

    return run


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _behind(t: pa.Table) -> pa.Table:
    """Costs to go behind each chunk of one conversation, from the last one's on."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["k"]), reverse=True)
    end, out = list(TAIL), []
    for r in rows:
        out.append(end)
        end = [min(r["costs"][4 * e + s] + end[e] for e in range(4)) for s in range(4)]
    return pa.table({"part": pa.array([r["part"] for r in rows], pa.int32()), "k": pa.array([r["k"] for r in rows], pa.int64()), "behind": pa.array(out, pa.list_(pa.int64()))})


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that are whole conversations, the others in order and with the costs behind them) of rows conv_id, turn,
    role, text and n, how often each row stands there. The first writes a table: enter scratch() around it."""
    chunks = materialize(_faults(rows).mapInArrow(_chunks, CHUNK), "chunks")
    whole = chunks.filter("whole").withColumn("behind", F.lit(None).cast("array<long>"))
    rest = chunks.filter("not whole")
    behind = rest.select("cn", "cv", "part", "k", "costs").groupBy("cn", "cv").applyInArrow(_behind, "part int, k long, behind array<long>")
    return whole, rest.join(behind, ["part", "k"]).select(whole.columns).repartition("cn", "cv").sortWithinPartitions("cn", "cv", "part", "k")


def report(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows
    conv_id, turn, role, text. copies names a column that says how often a row stands there (0: it counts for its id only)."""
    return _both(rows, copies, True, REPORT)


def repaired(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, place (from 0), role, text: the rebuilt turns."""
    return _both(rows, copies, False, TURNS)


def _both(rows: DataFrame, copies: str | None, digest: bool, schema: str) -> DataFrame:
    n = F.col(copies) if copies else F.lit(1)
    with scratch() as work:
        whole, rest = plan(rows.select("conv_id", "turn", "role", "text", n.cast("long").alias("n")))
        run = _finish(digest)
        return work.keep(whole.mapInArrow(run, schema).unionByName(rest.mapInArrow(run, schema)), "repair")

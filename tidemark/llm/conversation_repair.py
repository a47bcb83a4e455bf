"""Operator 11: repair of conversations by a Viterbi search whose survivors settle as they go.

A conversation's rows, by turn (nulls first; rows of a turn by a hash of role and text), are kept, reroled, deleted, or joined by inserted ones, at
the costs below, until the initials of its roles read ``(s?(ua)+)?``. Of the cheapest edits the ASCII-least string of initials (D, I, K, R) wins.

After each row one cheapest path survives per state (nothing yet, after system, user, assistant). Paths live in one tree of
back-pointers that counts references: a path that dies frees what only it held, and as soon as all survivors share an ancestor, the
edits up to it are final and leave. Equal costs are told apart by the whole unresolved ends of both paths, back to their fork. A survivor dearer than the
best by more than SLACK, what any state needs at most to do as any other, is dropped. What is held is the unsettled end alone.

Rows are dealt by ranges of (conversation, turn), so no task gets a long conversation whole. A task settles the conversations that begin and end in
it; the first and the last of a task, and any of over LONG rows or LONG_BYTES bytes, go on in parts: rows met before are found by grouping, each part gives the cheapest
edits from each state to each, these are chained part by part, and the rows are joined with their edits. Only the digest of such a conversation is read in one task, in order,
a slice of rows at a time, as a sha-256 has to be.

Nulls of role and text are one space, a null conversation is one of its own, and a null turn comes first. Repeated rows are duplicates of each other. A blank row is
never kept, so empty texts are deleted. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SLACK = 7
LONG = 5_000
LONG_BYTES = 8 << 20
BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ARCS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The one role of user and assistant that may follow a state.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
CLEAN, BLANK, DUPLICATE, CUT = range(4)


class Node:
    """An edit on a path; ``kids`` and ``held`` (survivors that end here) are its references."""

    __slots__ = ("parent", "edit", "state", "row", "depth", "kids", "held")

    def __init__(self, parent: Node | None, edit: str, state: int, row) -> None:
        self.parent, self.edit, self.state, self.row, self.kids, self.held = parent, edit, state, row, [], 0
        self.depth = parent.depth + 1 if parent else 0


class Viterbi:
    """Survivors of one conversation. ``settled`` holds edits (edit, state after it, row) that are final."""

    def __init__(self, entry: int = START, slack: int | None = SLACK) -> None:
        self.root = Node(None, "", entry, None)
        self.root.held = 1
        self.paths: dict[int, tuple[int, Node]] = {entry: (0, self.root)}
        self.slack = slack
        self.settled: list[tuple[str, int, object]] = []
        self.insert()

    @staticmethod
    def before(a: Node, x: str, b: Node, y: str) -> bool:
        """Whether the path to ``a`` and then edit x comes before that to ``b`` and then y, from their fork on."""
        ends = [x], [y]
        while a is not b:
            if a.depth >= b.depth:
                ends[0].append(a.edit)
                a = a.parent
            else:
                ends[1].append(b.edit)
                b = b.parent
        return ends[0][::-1] < ends[1][::-1]

    def offer(self, new: dict, state: int, cost: int, parent: Node, edit: str, row) -> None:
        old = new.get(state)
        if old is None or cost < old[0] or (cost == old[0] and self.before(parent, edit, old[1], old[2])):
            new[state] = (cost, parent, edit, row)

    def move(self, new: dict) -> None:
        """Make the paths offered the survivors, free those that died and settle what all share."""
        old = [node for _, node in self.paths.values()]
        if self.slack is not None and new:
            limit = min(c for c, *_ in new.values()) + self.slack
            new = {s: v for s, v in new.items() if v[0] <= limit}
        paths = {}
        for state, (cost, parent, edit, row) in new.items():
            node = parent
            if edit:
                node = Node(parent, edit, state, row)
                parent.kids.append(node)
            node.held += 1
            paths[state] = (cost, node)
        self.paths = paths
        for node in old:
            node.held -= 1
            while node.parent and not node.held and not node.kids:
                node.parent.kids.remove(node)
                node = node.parent
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.settled.append((self.root.edit, self.root.state, self.root.row))
            self.root.parent, self.root.row = None, None

    def insert(self) -> None:
        """Paths that a row put in leads to. A second one follows on the first, at most."""
        for _ in range(2):
            new = {s: (c, node, "", None) for s, (c, node) in self.paths.items()}
            for state, (cost, node) in self.paths.items():
                self.offer(new, NEXT[state], cost + INSERT, node, "I", None)
            if all(not v[2] for v in new.values()):
                break
            self.move(new)

    def step(self, initial: str, fault: int, row=None) -> None:
        new: dict = {}
        extra = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in self.paths.items():
            self.offer(new, state, cost + DELETE, node, "D", None)
            if fault in (BLANK, DUPLICATE):
                continue
            if (state, initial) in ARCS:
                self.offer(new, ARCS[state, initial], cost + KEEP + extra, node, "K", row)
            self.offer(new, NEXT[state], cost + REROLE + extra, node, "R", row)
        self.move(new)
        self.insert()

    def ends(self) -> dict[int, tuple[int, list[tuple[str, int, object]]]]:
        """Per state its cost and what is not settled of its path."""
        out = {}
        for state, (cost, node) in self.paths.items():
            tail = []
            while node is not self.root:
                tail.append((node.edit, node.state, node.row))
                node = node.parent
            out[state] = (cost, tail[::-1])
        return out

    def finish(self) -> int:
        """Settle the cheapest path that may end here; its cost."""
        ends = {s: v for s, v in self.ends().items() if s in ENDS}
        cost, tail = min(ends.values(), key=lambda v: (v[0], "".join(e for e, *_ in v[1])))
        self.settled += tail
        return cost


def fault_of(text: str) -> int:
    """CLEAN, BLANK or CUT."""
    left = text.rstrip(BLANKS)
    if not left:
        return BLANK
    return CLEAN if left[-1] in ".!?" else CUT


class Conversation:
    """One conversation's counts, repaired row by row."""

    def __init__(self) -> None:
        self.search, self.seen, self.rows, self.audit = Viterbi(), set(), [], []
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        fault, key = fault_of(text), (role, text)
        if fault != BLANK and key in self.seen:
            fault = DUPLICATE
        self.seen.add(key)
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        self.search.step(initial, fault, key)
        self.take()

    def take(self) -> None:
        for edit, state, row in self.search.settled:
            self.audit.append(edit)
            if edit != "D":
                self.rows.append((row[0] if edit == "K" else ROLE[state], row[1] if row else ""))
        self.search.settled.clear()

    def finish(self) -> dict:
        cost = self.search.finish()
        self.take()
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in self.rows).encode())
        return {
            "gaps": self.high - self.low + 1 - self.turns if self.turns else 0, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[CUT], "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "sha256": digest.hexdigest(),
        }


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPORT = f"{_COUNTS}, sha256 string"
# What a task leaves of a row: a repaired row, a row of a conversation that goes on in parts, or a report.
REPAIRED, RAW, REPORT = range(3)
_STATE = f"kind int, part int, row long, step int, turn long, role string, text string, initial string, fault int, same binary, report struct<{_REPORT}>"


def settle(rows: DataFrame, long: int = LONG) -> DataFrame:
    """Rows in order, in ranges, to repaired rows and reports, or to rows still to be worked on in parts."""
    place = rows.columns.index("c")
    schema = f"c {rows.schema['c'].dataType.simpleString()}, {_STATE}"
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    report = pa.struct([*[(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("sha256", pa.string())])
    names = ["c", "kind", "part", "row", "step", "turn", "role", "text", "initial", "fault", "same", "report"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        now, part, size, volume, at, first, raw = object(), 0, 0, 0, 0, True, False

        def spill() -> None:
            """Rows of a conversation that goes on elsewhere."""
            nonlocal held, at
            for turn, role, text in held:
                same = hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=16).digest()
                out.append((now, RAW, part, at, None, turn, role, text, role[:1], fault_of(text), same, None))
                at += 1
            held = []

        def whole() -> None:
            talk = Conversation()
            for row in held:
                talk.add(*row)
            found = talk.finish()
            for i, (role, text) in enumerate(talk.rows):
                out.append((now, REPAIRED, part, i, 0, None, role, text, None, None, None, None))
            out.append((now, REPORT, part, None, None, None, None, None, None, None, None, found))

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, [kind, *kinds, report], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind = batch.column(place).type
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for c, turn, role, text, part_ in zip(*(columns[n] for n in ("c", "turn", "role", "text", "part")), strict=True):
                if c != now:
                    if held or raw:
                        spill() if first or raw else whole()
                        first = False
                    now, part, size, at, raw, held = c, part_, 0, 0, False, []
                held.append((turn, role, text))
                size += len(role) + len(text)
                volume += len(role) + len(text)
                if len(held) >= long or size >= LONG_BYTES:
                    raw, size = True, 0
                    spill()
                if out and (len(out) >= 4096 or volume >= LONG_BYTES):
                    volume = 0
                    yield flush(kind)
        if held or raw:
            spill()
        if out:
            yield flush(kind)

    return rows.mapInArrow(run, schema)


def transfer(key, frame: pd.DataFrame) -> pd.DataFrame:
    """One part of a conversation: the cheapest edits from each state to each, and its counts."""
    frame = frame.sort_values("row")
    searches = [Viterbi(entry, None) for entry in range(4)]
    for initial, fault in zip(frame["initial"], frame["fault"], strict=True):
        for s in searches:
            s.step(initial, fault)
    turns = frame["turn"].dropna()
    faults = frame["fault"].value_counts()
    initials = frame["initial"].tolist()
    shared = {
        "g": key[0], "part": key[1], "first_turn": turns.iloc[0] if len(turns) else None, "last_turn": turns.iloc[-1] if len(turns) else None,
        "turns": turns.nunique(), "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "blank": faults.get(BLANK, 0), "duplicate": faults.get(DUPLICATE, 0), "truncated": faults.get(CUT, 0),
    }
    out = []
    for entry, s in enumerate(searches):
        for leave, (cost, tail) in s.ends().items():
            path = [*s.settled, *tail]
            edits = {"audit": "".join(e for e, *_ in path), "states": "".join(str(after) for _, after, _ in path)}
            out.append(shared | {"entry": entry, "leave": leave, "cost": cost} | edits)
    return pd.DataFrame(out)[list(_TRANSFER)]


_TRANSFER = {
    "g": "string", "part": "int", "first_turn": "long", "last_turn": "long", "turns": "long", "first": "string", "last": "string", "illegal": "long",
    "blank": "long", "duplicate": "long", "truncated": "long", "entry": "int", "leave": "int", "cost": "long", "audit": "string", "states": "string",
}
_CHAIN = f"g string, part int, entry int, leave int, {_COUNTS}"


def chain(key, frame: pd.DataFrame) -> pd.DataFrame:
    """The parts of a conversation in order: the states its cheapest edits enter and leave each by, and, on the row without a part, its counts."""
    best: dict[int, tuple[int, str, tuple[int, ...]]] = {START: (0, "", (START,))}
    totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = last = None
    parts = []
    for part, rows in frame.groupby("part", sort=True):
        parts.append(int(part))
        one = rows.iloc[0]
        for name in totals:
            totals[name] += int(one[name])
        totals["illegal"] += last is not None and last + one["first"] not in ("su", "ua", "au")
        last = one["last"]
        if not pd.isna(one["first_turn"]):
            totals["turns"] -= high is not None and int(one["first_turn"]) == high
            low, high = int(one["first_turn"]) if low is None else low, int(one["last_turn"])
        new: dict[int, tuple[int, str, tuple[int, ...]]] = {}
        for entry, leave, cost, audit in zip(rows["entry"], rows["leave"], rows["cost"], rows["audit"], strict=True):
            if entry in best:
                c, edits, states = best[entry]
                offer = (c + int(cost), edits + audit, (*states, int(leave)))
                new[leave] = min(offer, new.get(leave, offer))
        best = new
    cost, audit, states = min(best[s] for s in ENDS if s in best)
    gaps = high - low + 1 - totals["turns"] if high is not None else 0
    out = [(key[0], None, None, None, gaps, totals["blank"], totals["duplicate"], totals["truncated"], totals["illegal"], cost, audit)]
    out += [(key[0], part, *way, *[None] * 7) for part, way in zip(parts, zip(states, states[1:], strict=False), strict=True)]
    return pd.DataFrame(out, columns=["g", "part", "entry", "leave", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row of a part its edit, the role it is given, and the roles put in before it and, at the part's end, after it."""
    names = ["g", "part", "row", "ahead", "edit", "given", "after"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]
    for batch in batches:
        for g, part, audit, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out, ahead = [], []
            for edit, state in zip(audit, map(int, states), strict=True):
                if edit == "I":
                    ahead.append(ROLE[state])
                else:
                    out.append([g, part, len(out), ahead, edit, ROLE[state] if edit == "R" else None, []])
                    ahead = []
            out[-1][-1] = ahead
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha-256 of the lines of each g, joined by newlines; rows come in order."""
    now, running = None, None
    for batch in batches:
        done = []
        for g, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if g != now:
                if running:
                    done.append((now, running.hexdigest()))
                now, running = g, hashlib.sha256(line.encode())
            else:
                running.update(b"\n")
                running.update(line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["g", "sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (now, running.hexdigest())], names=["g", "sha256"])


@dataclass
class Repaired:
    """``rows``: conversation, place (part, row, step, in this order), role, text. ``reports``: one row a conversation."""

    rows: DataFrame
    reports: DataFrame


def repair(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> Repaired:
    """Repaired conversations and what was found and done to each."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    plain = df.select(F.col(conversation).alias("c"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    # The last number only deals equal rows out; nothing else depends on it.
    placed = plain.withColumn("h", F.xxhash64("role", "text")).withColumn("salt", F.monotonically_increasing_id())
    order = ["c", "turn", "h", "salt"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    state = materialize(settle(ranged.select("c", "turn", "role", "text", F.spark_partition_id().alias("part")), long))
    settled = state.where(F.col("kind") == REPAIRED).select("c", "part", "row", "step", "role", "text")
    reports = state.where(F.col("kind") == REPORT).select("c", "report.*")

    raw = state.where(F.col("kind") == RAW).withColumn("g", F.to_json(F.struct("c")))
    first = raw.groupBy("g", "same").agg(F.min(F.struct("part", "row")).alias("first"))
    again = (F.col("fault") != BLANK) & (F.struct("part", "row") != F.col("first"))
    light = raw.select("g", "part", "row", "turn", "initial", "fault", "same").join(first, ["g", "same"])
    light = light.select("g", "part", "row", "turn", "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    schema = ", ".join(f"{k} {v}" for k, v in _TRANSFER.items())
    transfers = materialize(light.groupBy("g", "part").applyInPandas(transfer, schema))
    chains = materialize(transfers.groupBy("g").applyInPandas(chain, _CHAIN))

    ways = chains.where("part IS NOT NULL").select("g", "part", "entry", "leave")
    chosen = transfers.join(ways, ["g", "part", "entry", "leave"]).select("g", "part", "audit", "states")
    edits = chosen.mapInArrow(edits_of, "g string, part int, row long, ahead array<string>, edit string, given string, after array<string>")
    put_in = lambda name: F.transform(name, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.coalesce("given", "role").alias("role"), F.col("text").alias("text")))
    lines = F.concat(put_in("ahead"), F.when(F.col("edit") != "D", own).otherwise(F.slice(own, 1, 0)), put_in("after"))
    joined = raw.select("g", "c", "part", "row", "role", "text").join(edits, ["g", "part", "row"])
    in_parts = materialize(joined.select("g", "c", "part", "row", F.posexplode(lines).alias("step", "line")).select("g", "c", "part", "row", "step", "line.role", "line.text"))

    place = ["g", "part", "row", "step"]
    ordered = in_parts.repartition("g").sortWithinPartitions(*place).select("g", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = ordered.mapInArrow(digests, "g string, sha256 string")
    named = raw.groupBy("g").agg(F.first("c").alias("c"))
    found = chains.where("part IS NULL").join(named, "g").join(hashed, "g", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = found.select(*[F.coalesce("sha256", nothing).alias(x) if x == "sha256" else F.col(x) for x in reports.columns])
    name = lambda d: d.withColumnRenamed("c", conversation)
    return Repaired(name(settled.unionByName(in_parts.drop("g"))), name(reports.unionByName(found)))

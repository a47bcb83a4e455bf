"""Conversation repair against a search over all edits and against plain dynamic programming."""

import hashlib
import heapq
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import conversation_repair as cr
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, fault name) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        left = text.strip(BLANKS)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by uniform-cost search over whole edit strings."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, last, kept = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, kept
        if (at, last) in done:
            continue
        done.add((at, last))
        full = {"u": "user", "a": "assistant"}
        more = [(2, "I", 0, x, (full[x], "")) for x in legal[last] if x in full]
        if at < len(rows):
            role, text, fault = rows[at]
            more.append((3, "D", 1, last, None))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                more += [(2 + extra, "R", 1, x, (full[x], text)) for x in legal[last] if x in full]
                if role[:1] and role[:1] in legal[last]:
                    more.append((extra, "K", 1, role[:1], (role, text)))
        for c, edit, step, state, row in more:
            heapq.heappush(heap, (cost + c, audit + edit, at + step, state, kept + ((row,) if row else ())))


def expected(rows, turns):
    """What the contract asks for one conversation, from its rows in order."""
    marked = faults(rows)
    cost, audit, kept = cheapest(marked)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    count = lambda f: sum(x[2] == f for x in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest


def damaged(rows):
    """Rows (turn, role, text) of each conversation after the damage, by turn."""
    out = {}
    for c, turn, role, text in rows:
        own = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)) for c, own in out.items()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def answers(reports, key="conv_id", digest="sha256"):
    return {r[key]: (*(r[f] for f in FIELDS), r[digest]) for r in reports.collect()}


def by_hand(talks):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: expected([r[1:] for r in rows], [r[0] for r in rows]) if rows else nothing for c, rows in talks.items()}


@pytest.mark.parametrize("long", [cr.LONG, 3])
def test_query(spark, long, monkeypatch):
    """The registered query, with conversations settled whole and in parts."""
    monkeypatch.setattr(cr.repair, "__defaults__", (*cr.repair.__defaults__[:-1], long))
    rows = duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()
    found = answers(QUERIES["op11_conversation_repair"](spark, FOLDER), digest="repaired_sha256")
    assert found == by_hand(damaged(rows))


def random_rows(rng, n):
    """(role, text) with every fault, on purpose with many ties; no two rows of a turn that a tie could swap."""
    roles = ["user", "assistant", "system", "tool", "", "assistants", " "]
    texts = ["a.", "b.", "c", "", " \n", "d!", "e?", "f. \t", "g"]
    chances = rng.dirichlet(np.ones(len(roles)) * rng.choice([0.2, 1, 3]))
    return [(str(rng.choice(roles, p=chances)), f"{texts[rng.integers(len(texts))]}" if rng.random() < 0.5 else f"{i}.") for i in range(n)]


def test_search():
    """Settled edits, freed paths and dropped survivors change no answer."""
    rng = np.random.default_rng(7)
    for _ in range(1500):
        rows = random_rows(rng, int(rng.integers(0, 14)))
        marked = faults(rows)
        codes = {None: cr.CLEAN, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.CUT}
        for slack in (cr.SLACK, None):
            search = cr.Viterbi(slack=slack)
            for role, _, fault in marked:
                search.step(role[:1], codes[fault])
            cost = search.finish()
            assert (cost, "".join(e for e, *_ in search.settled)) == cheapest(marked)[:2], (rows, slack)


def size(node):
    return 1 + sum(map(size, node.kids))


def test_memory():
    """The tree of unsettled edits stays small, however long the conversation is."""
    rng = np.random.default_rng(1)
    search, most = cr.Viterbi(), 0
    for i in range(20_000):
        search.step("u" if rng.random() < 0.1 else "ua"[i % 2], int(rng.choice([cr.CLEAN, cr.CUT, cr.BLANK], p=[0.8, 0.1, 0.1])))
        most = max(most, size(search.root))
    assert most < 60 and len(search.settled) > 19_000


def test_parts(spark):
    """A conversation of most rows, cut into many parts, with copies, null turns and roles; and small ones."""
    rng = np.random.default_rng(3)
    data = [(1, i if i else None, r, t) for i, (r, t) in enumerate(random_rows(rng, 700))]
    data += [(c, i * 2, r, t) for c in (2, 3, None) for i, (r, t) in enumerate(random_rows(rng, 6))]
    data += [(4, None, None, None), (5, 3, "user", "x" * 200_000), (5, 4, "assistant", "y.")]
    data += [(6, 1, "user", "same."), (6, 1, "user", "same."), (6, 1, "user", "same.")]
    talks = {}
    for c, turn, role, text in data:
        talks.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    wanted = by_hand({c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in talks.items()})
    df = spark.createDataFrame([(*r, 0) for r in data], "conv_id long, turn long, role string, text string, part int").repartition(5)
    for long in (cr.LONG, 20):
        found = cr.repair(df, long=long)
        assert answers(found.reports) == wanted
        lines = {}
        for r in found.rows.orderBy("part", "row", "step").collect():
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in wanted} == {c: w[-1] for c, w in wanted.items()}
    empty = cr.repair(df.limit(0))
    assert empty.reports.count() == 0 and empty.rows.count() == 0

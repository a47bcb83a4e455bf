"""Operator 4: byte-level BPE by prefix dynamic programming.

For each prefix of a piece's bytes there is one last token with which its encoding can end: the
one that is compatible with the last token of what stands before it. Two tokens are compatible
if their joined bytes encode to just these two. The table of last tokens gives the encoding by
walking back; appending bytes only extends it, and after an edit it is kept up to the edit
and rebuilt from there until tokens line up again.

Null texts count as empty: no ids, the hashes of nothing. Texts are whole; repeated rows are encoded
each. Ids of rows play no part. Empty tables give
empty results. Extra columns are kept, but must not bear the names of the added ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.llm.common import slices

_CACHED = 600_000  # pairs kept by a worker; beyond that it starts anew
_FIRST = 7  # bytes whose tables are kept for pieces that begin with them
_PIECES = 350_000  # pieces kept by a task, likewise; a slice of text may go beyond


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes pieces of bytes with the merges that a rank file implies."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.begun = {token[:n] for token in ranks for n in range(1, len(token) + 1)}  # what some token begins with
        self.tables: dict[bytes, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """By definition: join the neighbours of lowest rank until none (below a rank) can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = min(((r, i) for r, i in options if r is not None), default=None)
            if best is None or best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins; a single byte has no parts."""
        known = self.halves.get(token)
        if known is None:
            data = self.token[token]
            # Merges of a token's bytes up to, but without, the token itself.
            parts = self.merged(data, token) if len(data) > 1 else [token]
            known = self.halves[token] = (parts[0], parts[-1])
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens encode to just these two.

        Undoes the merges that face the border from the latest to the earliest; the border breaks
        where a token over it has a lower rank than the merges still standing at its sides.
        """
        known = self.pairs.get(left << 32 | right)
        if known is not None:
            return known
        if len(self.pairs) >= _CACHED:
            self.pairs.clear()
        token, ranks, split, a, b, limit = self.token, self.ranks, self.split, left, right, 1 << 62
        fits = None
        while fits is None:
            over = ranks.get(token[a] + token[b])
            if over is not None and over < limit:
                fits = False
                break
            # Of the two tokens at the border, the one merged last is undone first; at equal
            # ranks the left one came first.
            inner_a, inner_b = split(a)[1], split(b)[0]
            if (a > b or inner_b == b) and inner_a != a:
                limit, a = a, inner_a
            elif inner_b != b:
                limit, b = b + 1, inner_b
            else:
                fits = True
        self.pairs[left << 32 | right] = fits
        return fits

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``data``, given those of its first ``len(last)`` bytes."""
        ranks, pairs, begun = self.ranks, self.pairs, self.begun
        # Where no token begins with the bytes from a start on, none from there goes further either.
        least = max(0, len(last) + 1 - self.longest)
        for end in range(len(last) + 1, len(data) + 1):
            while least < end and data[least:end] not in begun:
                least += 1
            for start in range(least, end):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = pairs.get(before << 32 | token)
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                last.append(token)
                break
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        # A token's own bytes encode to itself wherever merges can build it.
        if whole is not None:
            return [whole]
        return self.walk(self.extend(piece, []))

    def encode_all(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Pieces and their ids. In order of bytes, so that a piece goes on from the table of the one before as far as the
        two agree, or from that of its first bytes."""
        old, last, tables = b"", [], self.tables
        if len(tables) >= _CACHED // 6:
            tables.clear()
        for piece in sorted(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                yield piece, [whole]
                continue
            agreed = next((i for i, (x, y) in enumerate(zip(old, piece, strict=False)) if x != y), min(len(old), len(piece)))
            known = last[:agreed]
            if agreed < _FIRST < len(piece):
                known = tables.get(piece[:_FIRST])
                if known is None:
                    known = tables[piece[:_FIRST]] = self.extend(piece[:_FIRST], last[:agreed])
                known = known[:]
            old, last = piece, self.extend(piece, known)
            yield piece, self.walk(last)

    def append(self, last: list[int], old: bytes, more: bytes) -> list[int]:
        """The table for ``old + more``; that of ``old`` is a prefix of it."""
        return self.extend(old + more, list(last))

    def edit(self, last: list[int], old: bytes, at: int, removed: int, added: bytes) -> tuple[list[int], bytes]:
        """The table and bytes after replacing ``removed`` bytes at ``at``.

        Entries before the edit stay. Behind it, an entry depends on at most ``longest`` entries
        before it: once that many in a row agree with the old ones, the rest is the old rest.
        """
        new = old[:at] + added + old[at + removed :]
        table, shift, agreed = list(last[:at]), len(added) - removed, 0
        for end in range(at + 1, len(new) + 1):
            self.extend(new[:end], table)
            past = end - len(added) - at
            if past >= self.longest and table[-1] == last[end - 1 - shift]:
                agreed += 1
                if agreed >= self.longest:
                    return table + last[end - shift :], new
            else:
                agreed = 0
        return table, new


@lru_cache(maxsize=4)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(load_ranks(path))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, and ``token_ids`` if asked for.

    Row-local: no shuffle. A task keeps of pieces it has met what they add to the digests, up to a bound; those
    new in a slice of text are encoded together.
    The rank file is read by each worker from a path that all have, like a library's data.
    """
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    schema = StructType([*docs.schema, *StructType.fromDDL(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, find, memory = _encoder(ranks_path), regex.compile(pattern).findall, {}
        token, sha, name = encoder.token.__getitem__, hashlib.sha256, {i: str(i) for i in encoder.token}.__getitem__
        place = docs_columns.index(text)
        for batch in slices(batches, place, 4 << 20):
            found = [find(value) if value else [] for value in batch.column(place).to_pylist()]
            if len(memory) >= _PIECES:
                memory.clear()
            for piece, ids in encoder.encode_all({piece.encode() for piece in set(chain.from_iterable(found)).difference(memory)}):
                memory[piece.decode()] = (" ".join(map(name, ids)), b"".join(map(token, ids)), tuple(ids) if with_ids else None)
            counts, ids_hash, decoded_hash, all_ids = [], [], [], []
            for pieces in found:
                known = list(map(memory.__getitem__, pieces))
                ids = " ".join([k[0] for k in known])
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_hash.append(sha(ids.encode()).hexdigest())
                decoded_hash.append(sha(b"".join([k[1] for k in known])).hexdigest())
                if with_ids:
                    all_ids.append(list(chain.from_iterable([k[2] for k in known])))
            more = [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            more += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    docs_columns = docs.columns
    names = [f.name for f in schema]
    return docs.mapInArrow(run, schema)

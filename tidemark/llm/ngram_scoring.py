"""Operator 1: n-gram scoring with Elias-Fano tries, one a shard.

The trie of a shard has three levels: words, the words before them, and the words before those.
Children of a node are hashed context ids, kept relative to their node; each level is one monotone
Elias-Fano sequence of (node number, id), with Elias-Fano pointers from nodes to their
children, quantised values, and a file that is memory-mapped. A query finds its node by a
successor search among the children of its context's node.

Probabilities pool the counts of all three levels (posterior mean under Dirichlet priors):
p(w | u v) = (A c(uvw) + B c(vw) + M p(w)) / (A c(uv) + B c(v) + M), with add-one p(w). They
sum to one, and numerator and denominator each are a sum over nodes of one word. So a token
is sent once, to the shard of its word: there, it counts (if its document trains) and is
scored. Words with more than a quarter of a shard's tokens, training or not, are split by the word before,
pairs with more than that by the word before those, and triples with more than that are dealt out evenly.
There are at most a few of each per shard, so their lists and counts, which go to all shards, have a known bound.

Null and empty texts consist of the end token alone. Rows without an id train and are scored.
Repeated rows count and are scored each. Empty tables give empty results. Extra columns
are not returned. Words are told apart by 64-bit hashes, contexts within a node by 32 bits.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, mix, slices, text_buffer, word_hashes

A, B, M = 12.0, 3.0, 40.0  # weights of trigram and bigram counts, and of the prior
SHARD_TOKENS = 1_500_000
END, BEGIN = np.uint64(1), np.uint64(2)  # hashes of the end token and of what precedes a text
_BATCH_TOKENS = 1_500_000
_BLOCK = 1 << 16


class EliasFano:
    """A monotone sequence: low bits packed, high bits as unary gaps, decoded by blocks."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, int(np.floor(np.log2(max(1, top / max(n, 1))))))
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) + n) if n else 0, np.uint8)
        unary[high + np.arange(n)] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        parts = []
        for a in range(0, n, _BLOCK):
            rows = values[a : a + _BLOCK, None] >> shifts & np.uint64(1)
            parts.append(np.packbits(rows.astype(np.uint8).ravel()).tobytes())
        # Where each block begins among the unary bits, and its first value, for successor search.
        starts = (high + np.arange(n))[::_BLOCK]
        head = np.array([n, low_bits, len(unary), len(starts)], np.int64).tobytes()
        return head + starts.astype(np.int64).tobytes() + values[::_BLOCK].astype(np.uint64).tobytes() + np.packbits(unary).tobytes() + b"".join(parts)

    def __init__(self, data: np.ndarray) -> None:
        self.n, self.low_bits, bits, blocks = (int(x) for x in data[:32].view(np.int64))
        self.starts = data[32 : 32 + 8 * blocks].view(np.int64)
        self.firsts = data[32 + 8 * blocks : 32 + 16 * blocks].view(np.uint64)
        at = 32 + 16 * blocks
        self.unary, self.low = data[at : at + (bits + 7) // 8], data[at + (bits + 7) // 8 :]
        self.bits = bits

    def block(self, i: int) -> np.ndarray:
        """The values of one block."""
        count = min(_BLOCK, self.n - i * _BLOCK)
        start = int(self.starts[i])
        stop = int(self.starts[i + 1]) if i + 1 < len(self.starts) else self.bits
        bits = np.unpackbits(self.unary[start >> 3 : (stop + 7) >> 3])[start & 7 :]
        high = (np.flatnonzero(bits)[:count] + start - i * _BLOCK - np.arange(count)).astype(np.uint64)
        if not self.low_bits:
            return high
        at = i * (_BLOCK * self.low_bits // 8)
        low = np.unpackbits(self.low[at : at + (count * self.low_bits + 7) // 8])[: count * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        packed = np.zeros(count, np.uint64)
        for j, w in enumerate(weights):
            packed += low[j :: self.low_bits] * w
        return high << np.uint64(self.low_bits) | packed

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of ascending wanted values, -1 where one is absent."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        owner = np.searchsorted(self.firsts, wanted, side="right") - 1
        edges = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip([0, *edges], [*edges, len(wanted)], strict=True):
            if owner[a] < 0:
                continue
            values = self.block(int(owner[a]))
            at = np.minimum(np.searchsorted(values, wanted[a:b]), len(values) - 1)
            out[a:b] = np.where(values[at] == wanted[a:b], at + int(owner[a]) * _BLOCK, -1)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.zeros(len(at), np.uint64)
        edges = np.flatnonzero(np.diff(at // _BLOCK)) + 1
        for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
            if b > a:
                block = int(at[a]) // _BLOCK
                out[a:b] = self.block(block)[at[a:b] - block * _BLOCK]
        return out


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes and their table of values: exact where there are few values, else bin means."""
    table, codes = np.unique(values, return_inverse=True)
    if len(table) > 65536:
        bins = (np.arange(len(table)) * 65536 // len(table))[codes]
        table = np.bincount(bins, values, 65536) / np.maximum(np.bincount(bins, minlength=65536), 1)
        codes = bins
    return codes.astype(np.uint16), table


class Trie:
    """Levels of a shard in one memory-mapped file."""

    def __init__(self, words: np.ndarray, before: np.ndarray, earlier: np.ndarray, times: np.ndarray, hot: list, prior: callable) -> None:
        """From sorted distinct (word, before, earlier) and how often each occurs.

        ``hot``: words, pairs and triples whose count is spread over shards. ``prior``: count -> M p(w).
        """
        new_word = np.concatenate(([True], words[1:] != words[:-1])) if len(words) else np.zeros(0, bool)
        new_pair = new_word | np.concatenate(([True], before[1:] != before[:-1])) if len(words) else new_word
        word_at, pair_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
        word_of_pair = np.searchsorted(word_at, pair_at, side="right") - 1
        pair_of = np.cumsum(new_pair) - 1
        c2 = np.add.reduceat(times, pair_at) if len(words) else times
        c1 = np.add.reduceat(times, word_at) if len(words) else times
        unique = words[word_at]
        pair, triple = _keys(words, before, earlier)
        c1, c2, times = _spread(unique, hot[0], c1), _spread(pair[pair_at], hot[1], c2), _spread(triple, hot[2], times)
        base = prior(c1)
        sections = {
            "words": EliasFano.encode(unique),
            # An id relative to its node: the node's number, then the 32-bit id of the context.
            "pairs": EliasFano.encode(word_of_pair.astype(np.uint64) << np.uint64(32) | before[pair_at].astype(np.uint64)),
            "triples": EliasFano.encode(pair_of.astype(np.uint64) << np.uint64(32) | earlier.astype(np.uint64)),
            # Monotone pointers from a node to its first child.
            "to_pairs": EliasFano.encode(np.searchsorted(word_of_pair, np.arange(len(word_at) + 1)).astype(np.uint64)),
            "to_triples": EliasFano.encode(np.searchsorted(pair_of, np.arange(len(pair_at) + 1)).astype(np.uint64)),
        }
        values = {
            "p1": np.log10(base), "p2": np.log10(B * c2 + base[word_of_pair]),
            "p3": np.log10(A * times + B * c2[pair_of] + base[word_of_pair][pair_of]),
            "d1": np.log10(B * c1 + M), "d2": np.log10(A * c2 + B * c1[word_of_pair] + M),
            "c1": c1,
        }
        self.tables = {}
        for name, v in values.items():
            if name == "c1":  # ranks of counts: exact
                self.tables[name], codes = np.unique(v, return_inverse=True)
                codes = codes.astype(np.uint32)
            else:
                codes, self.tables[name] = quantise(v)
            sections[name] = codes.tobytes()
        handle, path = tempfile.mkstemp(prefix="trie-")
        spots, at = {}, 0
        with os.fdopen(handle, "wb") as out:
            for name, data in sections.items():
                spots[name] = (at, len(data))
                out.write(data + b"\0" * (-len(data) % 8))
                at += len(data) + -len(data) % 8
        data = np.memmap(path, np.uint8, "r") if at else np.zeros(0, np.uint8)
        os.unlink(path)  # the mapping stays until it is dropped
        part = {k: data[a : a + n] for k, (a, n) in spots.items()}
        self.levels = {k: EliasFano(part[k]) for k in ("words", "pairs", "triples", "to_pairs", "to_triples")}
        self.codes = {k: part[k].view(np.uint32 if k == "c1" else np.uint16) for k in values}

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.tables[name][self.codes[name][at]]

    def descend(self, level: str, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Children of nodes with these ids, -1 where there is none. Ascending (node, id)."""
        out = np.full(len(nodes), -1, np.int64)
        known = np.flatnonzero(nodes >= 0)
        out[known] = self.levels[level].find(nodes[known].astype(np.uint64) << np.uint64(32) | ids[known].astype(np.uint64))
        return out


def _blob(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), *(len(c) for c in columns)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in columns))


def _unblob(data: bytes, kinds: list) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8 * (1 + len(kinds)), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds), 8), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and the row each is in."""
    raw, bounds = text_buffer(batch.column("text"))
    words, row = word_hashes(raw, bounds)
    words = np.where(words <= BEGIN, words + np.uint64(3), words)
    ends = np.searchsorted(row, np.arange(batch.num_rows), side="right")
    return np.insert(words, ends, END), np.insert(row, ends, np.arange(batch.num_rows))


def _trigrams(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Tokens, 32 bits of the word before and of the one before that, and the row each is in."""
    w, row = _tokens(batch)
    v, u = np.concatenate(([BEGIN], w[:-1])), np.concatenate(([BEGIN, BEGIN], w[:-2]))[: len(w)]
    v = np.where(v == END, BEGIN, v)
    u = np.where((u == END) | (v == BEGIN), BEGIN, u)
    return w, v.astype(np.uint32), u.astype(np.uint32), row


def _keys(w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of pairs (word, before) and of triples (word, before, earlier)."""
    pair = mix(w ^ (v.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return pair, mix(pair ^ (u.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the known ascending ones, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _spread(keys: np.ndarray, hot: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> np.ndarray:
    """Counts of keys: those over all shards where they are spread, else ``own``."""
    found, at = _among(keys, hot[0])
    out = own.astype(float)
    out[found] = hot[1][at[found]]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, trained): counts of all tokens and of those of training texts, by hash; summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, n, trained = (np.concatenate(c) for c in zip(*held, strict=True))
            w, inverse = np.unique(w, return_inverse=True)
            sums = (pa.array(np.bincount(inverse, c, len(w)).astype(np.int64)) for c in (n, trained))
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), *sums], names=["word", "n", "trained"])

        for batch in slices(batches, "text"):
            tokens, row = _tokens(batch)
            trains = batch.column("trains").to_numpy(zero_copy_only=False)[row]
            w, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            held, size = [*held, (w, n, np.bincount(inverse, trains, len(w)))], size + len(w)
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    counted = docs.select("text", "trains").mapInArrow(run, "word long, n long, trained long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _counted(rows: list, *columns: str) -> tuple[np.ndarray, ...]:
    """Keys of collected rows, ascending, and other columns of theirs."""
    key = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], *(np.array([r[c] for r in rows], np.int64)[order] for c in columns)


def hot_contexts(docs: DataFrame, words: np.ndarray, tokens: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs, then triples, that stand more than ``most`` times among all tokens, and their training counts.

    A pair in that share of all tokens exceeds half the share in some batches, by at least half of ``most``
    in all. Batches name those only, so few rows are shuffled and at most 2 tokens / most reach the driver. A second pass counts these.
    """
    half = most / 2 / max(tokens, 1)

    def contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        w, v, u, row = _trigrams(batch)
        of_hot = _among(w, words)[0]
        return *_keys(w[of_hot], v[of_hot], u[of_hot]), batch.column("trains").to_numpy(zero_copy_only=False)[row[of_hot]], len(w)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for level, keys in enumerate(zip(*held, strict=True), 1):
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                over = n - half * size
                key, over = key[over > 0], over[over > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64)), pa.array(over)], names=["level", "word", "over"])

        for batch in slices(batches, "text"):
            *keys, _, n = contexts(batch)
            held, size = [*held, keys], size + n
            if size > _BATCH_TOKENS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    source = docs.select("text", "trains")
    named = source.mapInArrow(often, "level int, word long, over double").groupBy("level", "word").agg(F.sum("over").alias("over"))
    named = named.where(F.col("over") > most / 2 * (1 - 1e-6)).collect()
    if not named:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
    wanted = [_counted([r for r in named if r["level"] == level])[0] for level in (1, 2)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(known))) for known in wanted]
        for batch in slices(batches, "text"):
            *keys, trains, _ = contexts(batch)
            for key, known, total in zip(keys, wanted, sums, strict=True):
                found, at = _among(key, known)
                total += [np.bincount(at[found], minlength=len(known)), np.bincount(at[found], trains[found], len(known))]
        for level, (known, total) in enumerate(zip(wanted, sums, strict=True), 1):
            n, trained = total.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), level, np.int32)), pa.array(known.view(np.int64)), pa.array(n), pa.array(trained)], names=["level", "word", "n", "trained"])

    exact = source.mapInArrow(count, "level int, word long, n long, trained long").groupBy("level", "word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))
    exact = exact.where(F.col("n") > most).collect()
    return [_counted([r for r in exact if r["level"] == level], "trained") for level in (1, 2)]


def _route(shards: int, hot: list[np.ndarray]) -> callable:
    """Tokens to shards: one row for a batch and shard, words in runs. ``hot``: words, pairs and triples to be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, v, u, row = (np.concatenate(c) for c in zip(*(h[:4] for h in held), strict=True))
            uid, own, trains = (np.concatenate(c) for c in zip(*(h[4:] for h in held), strict=True))
            place = w.copy()
            split = np.flatnonzero(_among(w, hot[0])[0])
            if len(split):
                pair, triple = _keys(w[split], v[split], u[split])
                by_earlier, evenly = _among(pair, hot[1])[0], _among(triple, hot[2])[0]
                turn = mix(np.arange(len(split), dtype=np.uint64) ^ np.uint64(int(uid[0])) << np.uint64(24))
                place[split] = np.where(evenly, turn, np.where(by_earlier, triple, pair))
            target = ((place >> np.uint64(17)) % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((w, target)) if shards > 1 else np.argsort(w, kind="stable")
            target = target[order]
            edges = np.searchsorted(target, np.arange(shards + 1))
            for s in range(shards):
                if edges[s] == edges[s + 1]:
                    continue
                pick = order[edges[s] : edges[s + 1]]
                ws, rows = w[pick], row[pick]
                first = np.flatnonzero(np.concatenate(([True], ws[1:] != ws[:-1])))
                there, rows = np.unique(rows, return_inverse=True)
                batch_key = int(uid[0])
                # A document is named where its one end token goes, and known by its place elsewhere.
                ends = rows[ws == END]
                data = _blob(
                    ws[first], np.diff([*first, len(ws)]).astype(np.uint32), v[pick], u[pick], rows.astype(np.uint32), there.astype(np.int64), trains[there],
                    ends.astype(np.uint32), own[there[ends]],
                )
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([batch_key]), pa.array([data], pa.binary())], names=["shard", "batch", "data"])

        for batch in slices(batches, "text"):
            w, v, u, row = _trigrams(batch)
            uid, own = batch.column("uid").to_numpy(), batch.column("own").to_numpy()
            trains = batch.column("trains").to_numpy(zero_copy_only=False).astype(np.uint8)
            held.append((w, v, u, row + docs, uid, own, trains))
            size, docs = size + len(w), docs + batch.num_rows
            if size > _BATCH_TOKENS:
                yield from flush()
                held, size, docs = [], 0, 0
        if held:
            yield from flush()

    return run


def _score_shard(tokens: int, vocabulary: int, texts: int, hot: list[tuple[np.ndarray, np.ndarray]]) -> callable:
    """Build a shard's trie from its training tokens, and score all its tokens with it."""
    prior = lambda c: M * (c + 1) / (tokens + vocabulary + 1)
    first_denominator = np.log10((A + B) * texts + M)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns, named, docs, edges = [], [], 0, [0]
        for data in frame["data"]:
            w, n, v, u, row, place, trains, ends, own = _unblob(data, [np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.int64, np.uint8, np.uint32, np.int64])
            columns.append((np.repeat(w, n), v, u, row.astype(np.int64) + docs, place, trains))
            named.append((place[ends], own))
            docs += len(place)
            edges.append(docs)
        w, v, u, row, place, trains = (np.concatenate(c) for c in zip(*columns, strict=True))
        del columns
        unique, number = np.unique(w, return_inverse=True)
        order = np.lexsort((u, number.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)))
        number, v, u, row = number[order], v[order], u[order], row[order]
        new = np.concatenate(([True], (number[1:] != number[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1])))
        at, gram = np.flatnonzero(new), np.cumsum(new) - 1
        times = np.bincount(gram, trains[row], len(at))
        gw, gv, gu = unique[number[at]], v[at], u[at]
        trained = times > 0
        trie = Trie(gw[trained], gv[trained], gu[trained], times[trained], hot, prior)
        # Each distinct n-gram is looked up once: word, then the context within its node, twice.
        n1 = trie.levels["words"].find(gw)
        n2 = trie.descend("pairs", n1, gv)
        n3 = trie.descend("triples", n2, gu)
        count = np.where(n1 >= 0, trie.value("c1", np.maximum(n1, 0)) if len(trie.codes["c1"]) else 0.0, 0.0)
        count = _spread(gw, hot[0], count)
        base = prior(count)
        # What is spread over shards may have trained at others alone.
        pair, triple = _keys(gw, gv, gu)
        two, three = _spread(pair, hot[1], np.zeros(len(gw))), _spread(triple, hot[2], np.zeros(len(gw)))
        elsewhere = np.log10(A * three + B * two + base)
        pick = lambda name, node, other: np.where(node >= 0, trie.value(name, np.maximum(node, 0)), other) if len(trie.codes[name]) else other
        over = pick("p3", n3, np.where(three > 0, elsewhere, pick("p2", n2, elsewhere)))
        under = pick("d2", n2, np.log10(A * two + B * count + M))
        # A token's own context comes next; the end has none, and stands for that of the first word.
        under = np.where(gw == END, first_denominator, under)
        total, plain = np.bincount(row, (over - under)[gram], docs), np.bincount(row, np.log10(count + 1)[gram], docs)
        known, size = np.bincount(row, (count > 0)[gram], docs), np.bincount(row, minlength=docs)
        # Back to the batches the tokens came from, a row for each.
        sums = [place.astype(np.uint32), total, plain, known.astype(np.uint32), size.astype(np.uint32)]
        parts = zip(edges, edges[1:], named, strict=False)
        return pd.DataFrame({"batch": frame["batch"], "data": [_blob(*(c[a:b] for c in sums), at.astype(np.uint32), own) for a, b, (at, own) in parts]})

    return run


def _sum_up(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of a batch, from what all shards found, each by its place in the batch and named by its own hash."""
    parts = [_unblob(d, [np.uint32, np.float64, np.float64, np.uint32, np.uint32, np.uint32, np.int64]) for d in frame["data"]]
    place, *values, at, own = (np.concatenate(c) for c in zip(*parts, strict=True))
    score, plain, known, size = (np.bincount(place, v) for v in values)
    names = np.zeros(len(size), np.int64)
    names[at] = own
    return pd.DataFrame({"own": names, "score": score, "plain": plain, "known": known.astype(np.int64), "size": size.astype(np.int64)})


def score(docs: DataFrame, trains: Column, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    On the driver: the totals, and words, pairs and triples with more than a quarter of a shard's tokens.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    counts = materialize(word_counts(rows))
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")
    ).first()
    texts = counts.where(F.col("word") == int(END)).agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    shards, most = 1 + total["all"] // shard_tokens, shard_tokens // 4
    hot = [_counted(counts.where(F.col("n") > most).collect() if shards > 1 else [], "trained")]
    hot += hot_contexts(rows, hot[0][0], total["all"], most) if len(hot[0][0]) else [hot[0]] * 2
    # Batches are told apart by the number of their first row, which counts in this pass alone. A row is known by its id and text, which
    # say the same whenever they are worked out; rows equal in both score alike.
    rows = rows.withColumn("own", F.xxhash64("doc_id", "text"))
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "own", "text", "trains")
    route = _route(shards, [keys for keys, _ in hot])
    routed = numbered.mapInArrow(route, "shard int, batch long, data binary")
    scored = _score_shard(total["n"], total["v"], texts, hot)
    parts = routed.groupBy("shard").applyInPandas(scored, "batch long, data binary")
    sums = parts.groupBy("batch").applyInPandas(_sum_up, "own long, score double, plain double, known long, size long").dropDuplicates(["own"])
    base = F.col("plain") - F.col("size") * F.lit(float(np.log10(total["n"] + total["v"] + 1)))
    return rows.select("own", "doc_id").join(sums, "own").select(
        "doc_id", F.col("size").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )

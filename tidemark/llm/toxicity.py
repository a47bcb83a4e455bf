"""Operator 7: toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, clause end, other. Small
weighted transducers rewrite them one after the other: negation turns an insult in its scope into
a denied one, reported speech into a quoted one, a target nearby into an aimed one, a threat
with a target into an aimed threat. They are composed into one deterministic table. A clause scores the sum
of its marks' weights; a document's score is a logistic function of what its clauses score.

Insults and their weights, and the logistic function, are learned from labelled rows: a bounded sample of
SAMPLE, by hash of the id. A word's weight is the lower confidence bound of its log-odds.

Null and empty texts have no clauses and get the score of such texts. Rows without an id belong to no fold
and are scored (held_out false). Repeated rows are scored each; a label given twice counts once, and
labels that disagree count as toxic. Without labels of both kinds the score is the share of toxic
labels (0 without labels). Empty tables give empty results. Extra columns are kept; the added
``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import materialize, slices

SAMPLE = 30_000
LEXICON = 2_000
MIN_DOCS = 3
MIN_WEIGHT = 1.5
# Words of closed classes, in the corpus' languages.
TARGETS = "you your yours he she they them him her we us these those du ihr sie ihn ihm er dich euch tu vous il elle ils lui leur tú usted ustedes él ella ellos le les".split()
NEGATIONS = "not no never nobody nor nicht nie kein keine keinen niemals pas jamais aucun sin nunca jamás ni tampoco".split()
REPORTS = "said says saying wrote writes called quoted reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill hurt destroy attack beat shoot burn töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")

# Symbols: other, insult, threat, target, negation, report, end; marks: aimed, denied, quoted, aimed threat.
SYMBOLS = "OIHTNREADQM"
MARKS = "IADQHM"


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight); other symbols pass and lead to ``rest``."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], rest: dict[int, int]) -> None:
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (self.rest[state], symbol, 0.0))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; weights add."""
        arcs, number, open_ = {}, {(0, 0): 0}, [(0, 0)]
        while open_:
            pair = open_.pop()
            for symbol in SYMBOLS:
                a, middle, w = self.step(pair[0], symbol)
                b, out, v = other.step(pair[1], middle)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    open_.append((a, b))
                arcs[number[pair], symbol] = (number[a, b], out, w + v)
        return Transducer(arcs, {n: n for n in number.values()})


def within(trigger: str, scope: int, rewrites: dict[str, tuple[str, float]]) -> Transducer:
    """Rewrite symbols that come within ``scope`` words after a trigger, in the same clause."""
    arcs = {(s, trigger): (scope, trigger, 0.0) for s in range(scope + 1)}
    arcs |= {(s, "E"): (0, "E", 0.0) for s in range(scope + 1)}
    arcs |= {(s, a): (s - 1, b, w) for s in range(1, scope + 1) for a, (b, w) in rewrites.items()}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(scope + 1)})


def grammar() -> Transducer:
    """Log factors on a mark's weight, by what stands before it in its clause."""
    denied = within("N", 3, {"I": ("D", -0.7), "H": ("D", -0.7)})
    quoted = within("R", 12, {"I": ("Q", -0.5), "H": ("Q", -0.5)})
    aimed = within("T", 5, {"I": ("A", 0.4), "H": ("M", 0.7)})
    return denied.then(quoted).then(aimed)


class Matcher:
    """Scores the clauses of a text."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.insults = insults
        self.symbol = dict.fromkeys(TARGETS, "T") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R")
        self.symbol |= dict.fromkeys(THREATS, "H") | dict.fromkeys(insults, "I")
        self.table = grammar()
        self.words = ahocorasick.Automaton()
        for word in [*insults, *THREATS]:
            self.words.add_word(word, word)
        self.words.make_automaton()

    def clauses(self, text: str) -> list[list[tuple[str, float]]]:
        """Marks and weights of each clause that has any."""
        low = text.lower()
        if next(self.words.iter(low), None) is None:
            return []
        out, marks, state = [], [], 0
        arcs, symbol = self.table.arcs, self.symbol
        for token in _TOKEN.findall(low):
            kind = "E" if token in _ENDS else symbol.get(token, "O")
            state, mark, log_factor = arcs[state, kind]
            if mark in MARKS:
                marks.append((mark, self.insults.get(token, 1.0) * np.exp(log_factor)))
            elif mark == "E" and marks:
                out.append(marks)
                marks = []
        return [*out, marks] if marks else out

    def features(self, text: str | None) -> list[float]:
        """Greatest clause score, and totals of aimed or plain, denied or quoted marks and threats."""
        found = self.clauses(text) if text else []
        score = [sum(w for m, w in clause if m not in "HM") for clause in found]
        total = lambda kinds: float(np.log1p(sum(w for c in found for m, w in c if m in kinds)))
        return [max(score, default=0.0), total("IA"), total("DQ"), total("HM")]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, bias last, by Newton steps with a ridge penalty."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, training, text: str = "text") -> tuple[dict[str, float], np.ndarray | None, float]:
    """Insults with weights (LEXICON at most), logistic weights, share of toxic labels.

    Driver and broadcasts hold at most SAMPLE ids, LEXICON words and SAMPLE rows of features.
    """
    clean = labels.where(training & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    one = clean.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    chosen = materialize(chosen)
    rows = materialize(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    toxic, harmless = n["t"], n["n"] - n["t"]
    if not toxic or not harmless:
        return {}, None, toxic / n["n"] if n["n"] else 0.0
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    seen = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (harmless + 1))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    weighed = seen.where(F.col("a") >= MIN_DOCS).select("word", (odds - 2 * spread).alias("w"))
    best = weighed.where(F.col("w") >= MIN_WEIGHT).orderBy(F.desc("w"), "word").limit(LEXICON).collect()
    insults = {r["word"]: r["w"] for r in best}
    scored = features(rows.select("toxic", "text"), insults, "text").select("toxic", "features").toPandas()
    x, y = np.stack(scored["features"]), scored["toxic"].to_numpy(float)
    return insults, fit_logistic(x, y), toxic / n["n"]


def features(docs: DataFrame, insults: dict[str, float], text: str) -> DataFrame:
    """``docs`` with ``features``."""
    schema, place = StructType([*docs.schema, *StructType.fromDDL("features array<double>")]), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(insults)
        for batch in slices(batches, place):
            found = [matcher.features(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, training=None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5)."""
    training = F.lit(True) if training is None else training
    insults, weights, share = learn(docs, labels, training, text)
    docs = docs.drop("score", "predicted")
    if weights is None:
        return docs.withColumn("score", F.lit(float(share))).withColumn("predicted", F.lit(int(share >= 0.5)))
    schema, place = StructType([*docs.schema, *StructType.fromDDL("score double")]), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(insults)
        for batch in slices(batches, place):
            x = np.array([matcher.features(t) for t in batch.column(place).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

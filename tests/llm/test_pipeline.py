"""Each stage of the pipeline against a plain version of it, on its own input; and on awkward rows."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import bpe, toxicity

from test_operators import AWKWARD, FOLDER, components_by_hand, shingle_set, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before each stage and after the last."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cp.materialize(stage(spark, out[-1], FOLDER)))
    return [df.collect() for df in out]


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
    assert sorted(map(tuple, stages[1])) == sorted(tuple(r) for r in stages[0] if r.doc_id in kept)


def cut_by_hand(rows, ratio=0.1, least=5):
    texts = {}
    for r in rows:
        texts.setdefault(r.source or "", set()).add(r.text or "")
    bad = {}
    for source, own in texts.items():
        count = Counter(line for t in own for line in {x.strip(" \t\r") for x in t.split("\n")} if line)
        bad[source] = {x for x, n in count.items() if n >= least and n > ratio * len(own)}
    out = []
    for r in rows:
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\r") not in bad[r.source or ""]]
        text = None if r.text is None else "\n".join(lines)
        out.append((r.doc_id, text, r.lang, r.source, r.n_chars if text == r.text else len(text)))
    return out


def test_lines(stages):
    assert sorted(map(tuple, stages[2])) == sorted(cut_by_hand(stages[1]))


def test_near_copies(stages):
    sets = {r.doc_id: shingle_set(r.text or "", cp.WORDS) for r in stages[2]}
    label = components_by_hand(sets, cp.PERCENT)
    assert sorted(map(tuple, stages[3])) == sorted(tuple(r) for r in stages[2] if label[r.doc_id] == r.doc_id)


def test_mix(stages):
    before, taken, own, largest = by_id(stages[3]), Counter(), Counter(), 0
    for r in stages[3]:
        own[r.source] += len(words(r.text or ""))
        largest = max(largest, len(words(r.text or "")))
    for r in stages[4]:
        assert tuple(r) == tuple(before[r.doc_id])
        taken[r.source] += len(words(r.text))
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3
    # Targets by hand: weights 1, 2, 3 over the sources in order; what a full source leaves goes to the others by weight.
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(own))}
    goal, full = {}, set()
    while True:
        rest = sum(own.values()) - sum(3 * own[s] for s in full)
        goal = {s: 3 * own[s] if s in full else rest * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in own}
        if not (more := {s for s in own if s not in full and goal[s] > 3 * own[s]}):
            break
        full |= more
    assert all(abs(taken[s] - goal[s]) <= largest for s in own)


def test_encoding(stages):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(stages[5]) == len(stages[4])
    texts = by_id(stages[4])
    for r in stages[5]:
        assert list(r.token_ids) == plain.encode_ordinary(texts[r.doc_id].text)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest()


def test_copies_leave_one_text(spark):
    """A source of five equal texts keeps one of them, with all its lines."""
    text = "a first line of the text\nand another line that stands here\nand one more for good measure"
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = cp.drop_boilerplate(spark, docs, FOLDER)
    assert {r.text for r in cut.collect()} == {text}
    assert [tuple(r) for r in cp.one_of_near_copies(spark, cut, FOLDER).collect()] == [(0, text, "en", "s", len(text))]


def test_awkward_rows(spark):
    """Nulls, blanks, repeats, long texts, clashing columns; and no rows: each stage but the last keeps the columns."""
    rows = [(*r, i, 7.5, i, "x") for i, r in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_tokens string")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in cp.STAGES[:-1]:
            kept = cp.materialize(stage(spark, kept, FOLDER))
            assert kept.columns == docs.columns, name
            if name in ("toxicity", "line_dedup"):
                assert {r.score for r in kept.collect()} <= {7.5}
                assert kept.count() == table.count()
        last = cp.encode(spark, kept, FOLDER)
        assert last.count() == kept.count()
        if table is docs:
            assert {r.doc_id for r in kept.collect()} >= {7, 8} and kept.where(F.col("text").isNull()).isEmpty()

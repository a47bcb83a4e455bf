"""Classification of articles: scoring, trimming, assembling, flattening.

Scores come from a native lexical scorer, from a pluggable Python scorer run in Arrow
batches, or from stored model replies. All three give one row per article and
classification without a shuffle or with one bounded by the spec.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ids import uuid5
from ..functions.scores import top_scores, with_label_scores
from ..specs import InferenceSpec
from ..schemas import DATA, SCORES, struct
from .lookup import lookup_frame

# --- scorers ---------------------------------------------------------------


class Scorer(Protocol):
    """``score`` returns a (texts x labels) matrix. Labels are scored on their own when
    ``multi_label``, else each row sums to 1."""

    def score(
        self, texts: Sequence[str], labels: Sequence[str], template: str, multi_label: bool
    ) -> np.ndarray: ...


def keywords(label: str) -> list[str]:
    return re.findall(r"[^\W_]+", label.lower())


class LexicalScorer:
    """Counts how often the words of a label occur in the text.

    With h hits, a label on its own scores h / (1 + h); among others it scores its share
    of 1 + h. Deterministic, and equal to :func:`with_lexical_scores`.
    """

    def score(self, texts, labels, template, multi_label):
        low = [t.lower() for t in texts]
        hits = np.array(
            [[float(sum(t.count(w) for w in keywords(x))) for x in labels] for t in low]
        ).reshape(len(low), len(labels))
        if multi_label:
            return hits / (1.0 + hits)
        return (1.0 + hits) / (1.0 + hits).sum(axis=1, keepdims=True)


def _occurrences(low: Column, word: str) -> Column:
    removed = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(word), F.lit("")))
    return removed.cast("double") / float(len(word.encode()))


def with_lexical_scores(articles: DataFrame, spec: InferenceSpec) -> DataFrame:
    """Articles with one ``_scores_<n>_<m>`` column per attribute, the lexical scorer as
    columns: no Python in the plan. Lower-casing and counting are steps of their own, as an
    expression used many times over would be worked out as often."""
    words = sorted(
        {w for attrs in spec.classifications.values() for a in attrs for x in a.labels for w in keywords(x.name)}
    )
    hits_of = {w: f"_hits_{i}" for i, w in enumerate(words)}
    counted = articles.withColumn("_low", F.lower(F.coalesce("content", F.lit("")))).withColumns(
        {name: _occurrences(F.col("_low"), w) for w, name in hits_of.items()}
    )

    def hits(label: str) -> Column:
        return sum((F.col(hits_of[w]) for w in keywords(label)), F.lit(0.0))

    columns = {}
    for n, attrs in enumerate(spec.classifications.values()):
        for k, a in enumerate(attrs):
            if a.top_n > 1:
                values = [hits(x.name) / (hits(x.name) + 1.0) for x in a.labels]
            else:
                total = sum((hits(x.name) + 1.0 for x in a.labels), F.lit(0.0))
                values = [(hits(x.name) + 1.0) / total for x in a.labels]
            columns[f"_scores_{n}_{k}"] = F.array(
                *[F.struct(F.lit(x.name).alias("label"), v.alias("score")) for x, v in zip(a.labels, values)]
            ).cast(SCORES)
    return counted.withColumns(columns).drop("_low", *hits_of.values())


# --- classification rows ---------------------------------------------------


def _row_id(article_id: Column, classification: Column, spec: InferenceSpec) -> Column:
    """Id from the article, the classification and its spec: the same on every retry."""
    hashes = F.create_map(
        *[x for name in spec.classifications for x in (F.lit(name), F.lit(spec.spec_hash(name)))]
    )
    return uuid5(F.concat_ws("/", article_id, classification, hashes[classification]))


def _finish(rows: DataFrame, spec: InferenceSpec, *extra: str) -> DataFrame:
    return rows.select(
        F.lower("classification").alias("classification"),
        _row_id(F.col("article_id"), F.col("classification"), spec).alias("id"),
        "article_id",
        F.date_trunc("second", "timestamp").alias("timestamp"),
        F.col("data").cast(DATA).alias("data"),
        *extra,
    )


Wanted = dict[str, list[str]]


def _asked_for(name: str, wanted: Wanted | None) -> Column:
    """Whether the row's source wants this classification. A source not listed gets them
    all, one with an empty list gets none."""
    refuse = [s for s, names in (wanted or {}).items() if name not in names]
    return ~F.col("source_id").isin(refuse) if refuse else F.lit(True)


def classify(articles: DataFrame, spec: InferenceSpec, wanted: Wanted | None = None) -> DataFrame:
    """Classification rows of every article (id, content, timestamp), lexically scored.
    One narrow pass: the attributes are columns of the row, the text is never copied.

    ``wanted`` (source_id -> classification names) needs a source_id column.
    """
    groups = []
    for n, (name, attrs) in enumerate(spec.classifications.items()):
        pairs = [
            F.struct(
                F.lit(a.name).alias("key"),
                top_scores(F.col(f"_scores_{n}_{k}"), a.cutoff, a.top_n).alias("value"),
            )
            for k, a in enumerate(attrs)
        ]
        group = F.struct(
            F.lit(name).alias("classification"), F.map_from_entries(F.array(*pairs)).alias("data")
        )
        groups.append(F.when(_asked_for(name, wanted), group))
    rows = with_lexical_scores(articles, spec).select(
        F.col("id").alias("article_id"), "timestamp", F.explode(F.array_compact(F.array(*groups))).alias("g")
    ).select("article_id", "timestamp", "g.classification", "g.data")
    return _finish(rows, spec)


@dataclass(frozen=True)
class Classified:
    """Classification rows, and the articles a scorer failed on."""

    rows: DataFrame
    failures: DataFrame


_TEXT = T.StringType()
_ATTRIBUTE_SCORES = struct(
    attribute=_TEXT,
    top_n=T.IntegerType(),
    cutoff=T.DoubleType(),
    labels=T.ArrayType(_TEXT),
    scores=T.ArrayType(T.DoubleType()),
)
_SCORED = struct(
    article_id=_TEXT,
    timestamp=T.TimestampType(),
    classification=_TEXT,
    scored=T.ArrayType(_ATTRIBUTE_SCORES),
    error=_TEXT,
)


def _score_batches(
    make_scorer: Callable[[], Scorer], spec: InferenceSpec
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = to_arrow_schema(_SCORED)

    def score(scorer: Scorer, texts: list[str], attrs) -> list[list[dict]]:
        per_attr = []
        for a in attrs:
            labels = [x.name for x in a.labels]
            matrix = np.asarray(scorer.score(texts, labels, a.prompt, a.top_n > 1), dtype="float64")
            if matrix.shape != (len(texts), len(labels)):
                raise ValueError(f"scorer gave {matrix.shape} for {len(texts)} texts, {len(labels)} labels")
            per_attr.append(
                [
                    {"attribute": a.name, "top_n": a.top_n, "cutoff": a.cutoff, "labels": labels, "scores": row}
                    for row in matrix.tolist()
                ]
            )
        return [list(row) for row in zip(*per_attr)]

    def score_each(scorer: Scorer, texts: list[str], attrs) -> tuple[list, list]:
        scored, errors = [], []
        for text in texts:
            try:
                scored += score(scorer, [text], attrs)
                errors.append(None)
            except Exception as problem:  # noqa: BLE001 - whatever a scorer raises is its result
                scored.append(None)
                errors.append(f"{type(problem).__name__}: {problem}")
        return scored, errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            wanted = batch.column("asked").to_pylist()
            for name, attrs in spec.classifications.items():
                asked = batch.filter(pa.array([name in names for names in wanted], pa.bool_()))
                if not asked.num_rows:
                    continue
                texts = asked.column("content").to_pylist()
                try:
                    scored, errors = score(scorer, texts, attrs), [None] * len(texts)
                except Exception:  # noqa: BLE001 - one bad text must not take its batch along
                    scored, errors = score_each(scorer, texts, attrs)
                columns = {
                    "article_id": asked.column("id"),
                    "timestamp": asked.column("timestamp"),
                    "classification": [name] * len(texts),
                    "scored": scored,
                    "error": errors,
                }
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type)
                        for k, c in columns.items()
                    ],
                    schema=schema,
                )

    return run


def classify_with(
    articles: DataFrame,
    spec: InferenceSpec,
    make_scorer: Callable[[], Scorer] = LexicalScorer,
    wanted: Wanted | None = None,
) -> DataFrame:
    """Like :func:`classify`, with a scorer made once per task and fed Arrow batches. Rows
    also carry ``error``: where scoring failed it is set and ``data`` is NULL."""
    asked = F.array_compact(
        F.array(*[F.when(_asked_for(n, wanted), F.lit(n)) for n in spec.classifications])
    )
    scored = articles.select(
        "id", F.coalesce("content", F.lit("")).alias("content"), "timestamp", asked.alias("asked")
    ).mapInArrow(_score_batches(make_scorer, spec), _SCORED)
    entries = F.transform(
        "scored",
        lambda a: F.struct(
            a["attribute"].alias("key"),
            top_scores(
                F.arrays_zip(a["labels"].alias("label"), a["scores"].alias("score")).cast(SCORES),
                a["cutoff"],
                a["top_n"],
            ).alias("value"),
        ),
    )
    rows = scored.select(
        "article_id", "timestamp", "classification", F.map_from_entries(entries).alias("data"), "error"
    )
    return _finish(rows, spec, "error")


def split_failures(rows: DataFrame) -> Classified:
    """Rows to store, and (article_id, classification, error) to retry later."""
    return Classified(
        rows.filter("error IS NULL").drop("error"),
        rows.filter("error IS NOT NULL").select("article_id", "classification", "error"),
    )


def classify_replies(replies: DataFrame, articles: DataFrame, spec: InferenceSpec) -> DataFrame:
    """Classification rows from stored model replies, one reply per article, classification
    and attribute. One unreadable or missing reply fails the whole row, as ``error`` says.

    Replies for attributes outside the spec are ignored. A group is as large as the spec
    has attributes, once repeated replies to one question are reduced to one.
    """
    limits = lookup_frame(
        replies.sparkSession,
        [
            {"classification": n, "attribute": a.name, "top_n": a.top_n, "cutoff": a.cutoff}
            for n, attrs in spec.classifications.items()
            for a in attrs
        ],
        pa.schema(
            [
                ("classification", pa.string()),
                ("attribute", pa.string()),
                ("top_n", pa.int32()),
                ("cutoff", pa.float64()),
            ]
        ),
    )
    asked = F.create_map(
        *[x for n, attrs in spec.classifications.items() for x in (F.lit(n), F.lit(len(attrs)))]
    )
    # Of repeated replies the newest counts, where their time is known, then the greatest by text.
    when = F.col("received_at") if "received_at" in replies.columns else F.lit(0)
    newest = F.max(F.struct(when, "raw"))["raw"]
    single = replies.groupBy("article_id", "classification", "attribute").agg(newest.alias("raw"))
    parsed = single.join(limits, ["classification", "attribute"])
    parsed = with_label_scores(parsed, "raw").select(
        "article_id",
        "classification",
        "attribute",
        "error",
        top_scores(F.col("scores"), F.col("cutoff"), F.col("top_n")).alias("scores"),
    )
    grouped = parsed.groupBy("article_id", "classification").agg(
        F.map_from_entries(F.collect_list(F.struct("attribute", "scores"))).alias("data"),
        F.count(F.lit(1)).alias("answered"),
        F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "attribute", "error"))).alias("error"),
    )
    checked = grouped.withColumn(
        "error",
        F.coalesce(
            "error",
            F.when(F.col("answered") < asked[F.col("classification")], "reply missing for an attribute"),
        ),
    ).withColumn("data", F.when(F.col("error").isNull(), F.col("data")))
    joined = checked.join(articles.select(F.col("id").alias("article_id"), "timestamp"), "article_id")
    return _finish(joined, spec, "error")


def flatten(classifications: DataFrame) -> DataFrame:
    """The metrics rows of classification rows: one per attribute and label."""
    return (
        classifications.select(
            "classification", "article_id", "timestamp", F.explode("data").alias("category", "scores")
        )
        .select("classification", "article_id", "category", "timestamp", F.inline("scores"))
        .select("classification", "article_id", "category", "label", "timestamp", "score")
    )


def dead_letters(failures: DataFrame, cap: int = 5) -> DataFrame:
    """Articles that failed at least ``cap`` times, with the error of their last batch; of
    several in one batch, and where batches are not known, the greatest by text."""
    batch = F.col("batch_id") if "batch_id" in failures.columns else F.lit(0)
    return (
        failures.groupBy("article_id", "classification")
        .agg(F.count(F.lit(1)).alias("attempts"), F.max(F.struct(batch, "error"))["error"].alias("error"))
        .filter(F.col("attempts") >= cap)
    )

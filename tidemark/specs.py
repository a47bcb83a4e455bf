"""Requests and configuration: small Python objects that live on the driver."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


# --- time ranges -----------------------------------------------------------

# The length of each relative unit, in days.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


@dataclass(frozen=True)
class Range:
    unit: str = ""
    count: int = 0
    start: str = ""
    end: str = ""


def resolve_range(r: Range | None, as_of: dt.datetime) -> tuple[str, str]:
    """(start, end) text, each possibly empty. An absolute bound wins over a relative
    window; a window that makes no sense leaves the range open."""
    if r is None:
        return "", ""
    if r.start or r.end:
        return r.start, r.end
    if r.count <= 0 or not r.unit:
        return "", ""
    end = _utc(as_of).replace(microsecond=0)
    start = end - dt.timedelta(days=UNIT_DAYS.get(r.unit, 0) * r.count)
    return _rfc3339(start), _rfc3339(end)


def _utc(t: dt.datetime) -> dt.datetime:
    return t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t.astimezone(dt.timezone.utc)


def _rfc3339(t: dt.datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


# --- search requests -------------------------------------------------------


@dataclass(frozen=True)
class SearchRequest:
    classification: str = ""
    title: str = ""
    labels: tuple[str, ...] = ()
    start: str = ""
    end: str = ""
    cutoff: float = 0.0
    limit: int = 50

    @classmethod
    def from_params(cls, params: dict[str, list[str]]) -> SearchRequest:
        """Build from raw text parameters; out-of-range numbers fall back to defaults."""

        def first(key: str) -> str:
            return (params.get(key) or [""])[0]

        return cls(
            classification=first("classification"),
            title=first("title"),
            labels=tuple(params.get("label") or ()),
            start=first("start"),
            end=first("end"),
            cutoff=_bounded(first("cutoff"), float, lambda v: 0.0 < v <= 0.99, 0.0),
            limit=_bounded(first("limit"), int, lambda v: 0 < v <= 200, 50),
        )


def _bounded(raw: str, kind, ok, default):
    try:
        value = kind(raw)
    except ValueError:
        return default
    return value if ok(value) else default


# --- what to classify ------------------------------------------------------


@dataclass(frozen=True)
class Label:
    name: str
    definition: str = ""


@dataclass(frozen=True)
class Attribute:
    """``None`` for top_n or cutoff inherits the default; 0 does not."""

    name: str
    labels: tuple[Label, ...]
    prompt: str = "This text is about {}."
    instruction: str = ""
    top_n: int | None = None
    cutoff: float | None = None


@dataclass(frozen=True)
class InferenceSpec:
    """classification name -> attributes, with every default resolved."""

    classifications: dict[str, tuple[Attribute, ...]] = field(default_factory=dict)

    @classmethod
    def resolve(
        cls,
        classifications: dict[str, list[Attribute]],
        default_top_n: int = 1,
        default_cutoff: float = 0.0,
    ) -> InferenceSpec:
        def settle(a: Attribute) -> Attribute:
            return Attribute(
                a.name,
                tuple(a.labels),
                a.prompt,
                a.instruction,
                default_top_n if a.top_n is None else a.top_n,
                default_cutoff if a.cutoff is None else a.cutoff,
            )

        return cls(
            {name: tuple(settle(a) for a in attrs) for name, attrs in classifications.items()}
        )

    def restrict(self, names) -> InferenceSpec:
        """Only the named classifications (a source may ask for some of them)."""
        wanted = set(names)
        return InferenceSpec({k: v for k, v in self.classifications.items() if k in wanted})

    def spec_hash(self, classification: str) -> str:
        body = json.dumps([asdict(a) for a in self.classifications[classification]], sort_keys=True)
        return hashlib.sha256(body.encode()).hexdigest()

    def attribute_names(self) -> dict[str, list[str]]:
        return {name: [a.name for a in attrs] for name, attrs in self.classifications.items()}

    def label_axis(self) -> dict[str, float]:
        """label -> axis position, first seen first, classifications by name."""
        axis: dict[str, float] = {}
        for name in sorted(self.classifications):
            for attr in self.classifications[name]:
                for label in attr.labels:
                    axis.setdefault(label.name, float(len(axis)))
        return axis

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per classification x attribute."""
        rows = [
            {
                "classification": name,
                "attribute": a.name,
                "prompt": a.prompt,
                "instruction": a.instruction,
                "top_n": a.top_n,
                "cutoff": a.cutoff,
                "labels": [asdict(label) for label in a.labels],
                "system_prompt": classify_prompt(a),
            }
            for name, attrs in self.classifications.items()
            for a in attrs
        ]
        label_type = pa.list_(pa.struct([("name", pa.string()), ("definition", pa.string())]))
        schema = pa.schema(
            [
                ("classification", pa.string()),
                ("attribute", pa.string()),
                ("prompt", pa.string()),
                ("instruction", pa.string()),
                ("top_n", pa.int32()),
                ("cutoff", pa.float64()),
                ("labels", label_type),
                ("system_prompt", pa.string()),
            ]
        )
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def classify_prompt(attr: Attribute) -> str:
    """System message asking a remote model to score one attribute's labels."""
    listed = [f"- {x.name}: {x.definition}" if x.definition else f"- {x.name}" for x in attr.labels]
    # The wording models were asked with, so stored replies stay comparable.
    closing = [
        "Return a JSON object mapping each applicable label name to a confidence score from 0.0 to 1.0.",
        'Format: {"Label A": 0.85, "Label B": 0.4}',
    ]
    if attr.cutoff:
        closing.append(f"Only include labels with confidence at or above {attr.cutoff:.2f}.")
    closing.append("Return JSON only. No prose, no preamble, no trailing commentary.")
    opening = [attr.instruction, ""] if attr.instruction else []
    return "\n".join([*opening, "Available labels:", *listed, "", *closing])

"""Personal data by weak supervision.

Four kinds follow fixed patterns and are always reported (base spans). A fifth, `secret`
(credentials and other keys of a person), has no single pattern, so it is learned without labels:

1. labelers propose candidates: the value after a key name, of any length and characters; runs of 16
   key characters or more, also with / + . =, of any length; loose shapes of phone and account numbers;
2. labelers (shape, gazetteer of key names, context, make-up of the run, and a negative one for
   addresses and paths) vote yes, no or abstain on each;
3. expectation-maximisation over the vote patterns of all documents estimates how reliable each
   labeler is for yes and for no, and so the probability of each pattern;
4. a logistic span classifier is trained on those probabilities, over votes and features of the
   run, and decides on every candidate.

Vote patterns are counted by Spark (3^5 at most reach the driver); the classifier is fitted on at most
SAMPLE distinct feature rows, by hash. Added spans never overlap base spans, which stay as they are.

Defined results: null and empty texts have no spans; texts are read whole, in time linear in
their length; offsets are code points, end exclusive; every row gives a row, also for null and
repeated ids; without candidates nothing is added; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SAMPLE = 20_000
_CONTEXT = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Every match lies around an @: the run of name characters before it, a dotted name after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    """Dotted numbers in fours, from the left of each run."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed kinds, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += _ips(text)
        for m in _CARD.finditer(text):
            d = _digits(m.group()) if m.end() - m.start() >= 14 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# candidates and their labelers; votes are 1 (yes), 0 (no), 2 (abstains)
_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}")
# base64 and dotted keys: the same with / + . = in it
_WIDE_RUN = re.compile(r"(?<![A-Za-z0-9_/+.=-])[A-Za-z0-9_/+.=-]{16,}")
_UPPER, _LOWER = re.compile(r"[A-Z]"), re.compile(r"[a-z]")
# digits in groups, with or without two letters before them, as in phone and account numbers
_NUMBER = re.compile(r"(?<![A-Za-z0-9.,+-])(?:[A-Z]{2})?\(?[0-9]{2,}(?:[\x20()/-]{1,2}[A-Z]{0,4}[0-9]+)*(?![A-Za-z0-9])")
# fixed values: usual names of credentials
_KEY_NAMES = re.compile(
    r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)[\"']?\s*(?:=|:|is)?\s*[\"']?$"
)
_NAMED = re.compile(
    r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)[\"']?[\x20\t]*[=:][\x20\t]*(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;]+))"
)
# fixed values: usual names of phone and account numbers
_NUMBER_NAMES = re.compile(r"(?i)(?:phone|tel|telephone|mobile|cell|fax|call|iban|account|acct|konto|ssn|passport)\.?(?:[\x20_-]?(?:no|nr|number)\.?)?[\"']?\s*(?:=|:|is|#)?\s*[\"']?$")
_SHAPE = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|sk[-_][A-Za-z0-9_-]{16,}|[0-9a-f]{16,}|[0-9A-F]{16,}")
_PATH = re.compile(r"(?:https?:|www\.|[/\\])[^\s\"']*$")


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Spans that a labeler proposes, by start; of overlapping proposals the first in this order stays:
    value after a key name, wide run of mixed characters outside a path, key run, number."""
    taken = _Taken((s, e) for _, s, e in base)
    found = []
    for m in _NAMED.finditer(text):
        found.append(m.span(m.lastindex))
    for m in _WIDE_RUN.finditer(text):
        start, end = m.start(), m.start() + len(m.group().rstrip("."))
        run = text[start:end]
        mixed = _UPPER.search(run) and _LOWER.search(run) and _DIGIT.search(run)
        if mixed and any(c in run for c in "/+.=") and run[0] not in "/." and not _PATH.search(text[max(0, start - _CONTEXT) : start]):
            found.append((start, end))
    # a run of letters only is a word unless its case is mixed inside it
    for m in _RUN.finditer(text):
        run = m.group()
        if _DIGIT.search(run) or _UPPER.search(run, 1) and _LOWER.search(run):
            found.append(m.span())
    for m in _NUMBER.finditer(text):
        if 7 <= len(_digits(m.group())) <= 34:
            found.append(m.span())
    yield from sorted(s for s in found if taken.add(*s))


class _Taken:
    """Spans that do not overlap, apart from the first ones."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Takes a span if it is free."""
        i = bisect_left(self.ends, start + 1)
        if start >= end or i < len(self.starts) and self.starts[i] < end:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def _votes(run: str, before: str) -> tuple[int, ...]:
    digits = sum(c.isdigit() for c in run) / len(run)
    return (
        1 if _SHAPE.fullmatch(run) and digits < 1 else 2,
        1 if _KEY_NAMES.search(before) or (digits > 0.3 and _NUMBER_NAMES.search(before)) else 2,
        1 if before.rstrip("\"' ")[-1:] in ("=", ":") else (0 if before[-1:] in "/.\\@" and before else 2),
        1 if 0.1 <= digits <= 0.9 and len(set(run)) >= 8 else 0,
        0 if _PATH.search(before) else 2,
    )


LABELERS = len(_votes("0", ""))


def pattern_of(votes: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def votes_of(pattern: int) -> tuple[int, ...]:
    return tuple(pattern // 3**i % 3 for i in range(LABELERS))


def _features(run: str, votes: tuple[int, ...]) -> list[float]:
    """Features of a candidate: its make-up, then each vote as two indicators."""
    n = len(run)
    make_up = [
        sum(c.isdigit() for c in run) / n,
        sum(c.isupper() for c in run) / n,
        sum(c in "0123456789abcdefABCDEF" for c in run) / n,
        len(set(run)) / n,
        min(n, 64) / 64,
    ]
    return make_up + [float(v == x) for v in votes for x in (0, 1)]


@dataclass(frozen=True)
class SpanModel:
    """Labeler reliabilities (labeler x class x vote) and the classifier's weights."""

    reliability: np.ndarray
    prior: float
    weights: np.ndarray

    def probability(self, run: str, votes: tuple[int, ...]) -> float:
        x = np.array([*_features(run, votes), 1.0])
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def _posterior(votes: np.ndarray, reliability: np.ndarray, prior: float) -> np.ndarray:
    log = np.log([1 - prior, prior]) + np.log(reliability[np.arange(LABELERS)[:, None], :, votes.T]).sum(axis=0)
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: reliabilities, prior and the probability of each pattern.

    It starts from the majority of the votes cast; a little mass on every outcome keeps it finite.
    """
    yes, no = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    p = (yes + 0.5) / (yes + no + 1.0)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        reliability = np.stack([[np.bincount(votes[:, i], w, minlength=3) + 0.5 for w in weight] for i in range(LABELERS)])
        reliability /= reliability.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        new = _posterior(votes, reliability, prior)
        moved, p = np.abs(new - p).max(), new
        if moved < 1e-9:
            break
    return reliability, prior, p


def _classifier(x: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta, penalty = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + penalty, x.T @ (weight * (p - q)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, sample: int = SAMPLE) -> SpanModel | None:
    """Model of the candidates in all texts of `docs`; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, features = [], []
            for text in batch.column(0).to_pylist():
                if text:
                    for start, end in candidates(text, base_spans(text)):
                        votes = _votes(text[start:end], text[max(0, start - _CONTEXT) : start])
                        patterns.append(pattern_of(votes))
                        features.append(np.round(_features(text[start:end], votes), 6).tolist())
            yield pa.record_batch(
                [pa.array(patterns, pa.int32()), pa.array(features, pa.list_(pa.float64()))], names=["pattern", "features"]
            )

    found = settled(docs.select("text").mapInArrow(run, "pattern int, features array<double>"), "candidates")
    totals = found.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not totals:
        return None
    votes = np.array([votes_of(r.pattern) for r in totals])
    reliability, prior, p = estimate(votes, np.array([r.n for r in totals], float))
    probability = dict(zip((r.pattern for r in totals), p.tolist(), strict=True))
    kinds = found.groupBy("pattern", "features").agg(F.count("*").alias("n"))
    rows = kinds.orderBy(F.xxhash64("features"), "pattern").limit(sample).collect()
    x, y = np.array([r.features for r in rows]), np.array([probability[r.pattern] for r in rows])
    return SpanModel(reliability, prior, _classifier(x, y, np.array([r.n for r in rows], float)))


def all_spans(text: str, base: list[Span], model: SpanModel | None) -> list[Span]:
    """Base spans and the candidates that the classifier takes."""
    if model is None:
        return base
    more = [
        ("secret", s, e)
        for s, e in candidates(text, base)
        if model.probability(text[s:e], _votes(text[s:e], text[max(0, s - _CONTEXT) : s])) >= 0.5
    ]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _arrow(spans: list[list[Span]]) -> pa.Array:
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in one] for one in spans], pa.list_(item))


def detected(docs: DataFrame, model: SpanModel | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with base and spans: arrays of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = [all_spans(t, b, shared.value) for t, b in zip(texts, base, strict=True)]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, _arrow(base), _arrow(spans)], names=[*keep, "base", "spans"])

    given = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema)
    return given.mapInArrow(run, f"{fields}, base {_SPANS}, spans {_SPANS}")


def redacted(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """`docs` with every span of its texts replaced by its kind, as in <EMAIL>; overlapping spans by the first kind."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def clean(text: str) -> str:
        spans = all_spans(text, base_spans(text), shared.value)
        out, done, kind, end = [], 0, "", 0
        for k, s, e in [*spans, ("", len(text) + 1, 0)]:
            if kind and s >= end:
                out.append(f"<{kind.upper()}>")
                done, kind = end, ""
            if not kind and k:
                out.append(text[done:s])
                kind, end = k, e
            end = max(end, e) if k else end
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([t if not t else clean(t) for t in batch.column(at).to_pylist()], pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

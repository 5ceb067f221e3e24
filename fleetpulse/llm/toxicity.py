"""Toxicity by the nearest labelled examples.

Examples are labelled texts as TF-IDF vectors over all of their terms, each term weighed further by how
much it tells of the label (the squared correlation of its presence with the label among the examples).
The K examples of largest cosine vote, weighted by nearness: their cosine times the part of the text's
own length that tells anything. A pseudo-vote of the label's share among the examples stands against
them, so far or weak neighbours leave the vote near that share. The vote alone is calibrated into a
probability; the examples that voted are the evidence. Weight of the pseudo-vote and calibration come
from cross-validation: each fold of the examples is judged by an index of the others.

The search is exact: postings lie in blocks of BLOCK examples with the greatest weight of each term in
each block it stands in. Terms that stand in one example of thirty-two or more have their weights as whole
rows instead, which are summed first, for all examples and many texts at once; to the greatest of these
sums in a block the greatest weights of the rare terms give its bound. Blocks are taken in the order of
their bound, and the search ends when no block can beat the K-th example found. Terms of a text that no
example has are left out.

Bound, a parameter: at most PER_CLASS examples of each label (by hash of the id). Document
frequencies for IDF are counted over all documents, for every term of the examples.

Defined results: null, empty and foreign texts, which share no term with an example, get the share of
label 1 among the learn rows; an id labelled several times counts once, toxic if any label says so, and an
id with several texts is an example by one of them;
null labels are not learned from; without both labels among the learn rows the score is that share
(0 if there are none); every row gives a row, also for null and repeated ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import word_bounds, word_hashes

PER_CLASS = 1500
K = 24
BLOCK = 64
_FIRST_BLOCKS = 6
# terms in a part of the examples of 1 / _COMMON or more are rows
_COMMON = 32
_TEXTS = 64
_PARTS = 64
_FOLDS = 4
# tried weights of the pseudo-vote, for each neighbour, in units of nearness
DOUBTS = (0.0, 1e-5, 1e-4, 1e-3, 1e-2)

# terms are runs of letters, digits and bytes beyond ASCII
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of a text, ascending, and their counts."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return np.unique(word_hashes(raw, *word_bounds(raw, _BETWEEN)), return_counts=True)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class ExampleIndex:
    """Block-max inverted index over the examples of one label set.

    Entries stand for a term in a block: those of term t are first[t] to first[t + 1], by block.
    Postings of entry e are start[e] to start[e + 1].
    """

    terms: np.ndarray  # hashes, ascending
    idf: np.ndarray
    relevance: np.ndarray  # squared correlation of each term with the label, 0 to 1
    first: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    start: np.ndarray
    example: np.ndarray
    value: np.ndarray
    labels: np.ndarray  # blocks x BLOCK, -1 where there is no example
    ids: np.ndarray
    prior: float
    k: int = K
    doubt: float = 0.0
    curve: np.ndarray | None = None  # factor and offset from vote to log-odds
    common: np.ndarray | None = None  # row of each term in `rows`, -1 for terms with postings alone
    rows: np.ndarray | None = None  # weights of common terms, terms x places

    def __post_init__(self):
        spread = self.start[self.first[1:]] - self.start[self.first[:-1]] if len(self.terms) else np.zeros(0, np.int64)
        wide = np.flatnonzero(spread * _COMMON >= np.count_nonzero(self.labels >= 0))
        self.common = np.full(len(self.terms), -1)
        self.common[wide] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), self.labels.size), np.float32)
        at = _ranges(self.start[self.first[wide]], self.start[self.first[wide + 1]]) if len(wide) else np.zeros(0, np.int64)
        self.rows[np.repeat(np.arange(len(wide)), spread[wide]), self.example[at]] = self.value[at]

    @property
    def postings(self) -> np.ndarray:
        """All weights as a dense array, blocks x terms x BLOCK: to look at small indexes."""
        dense = np.zeros((self.labels.size, len(self.terms)), np.float32)
        dense[self.example, np.repeat(np.repeat(np.arange(len(self.terms)), np.diff(self.first)), np.diff(self.start))] = self.value
        return dense.reshape(len(self.labels), BLOCK, -1).transpose(0, 2, 1)

    def query(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Index terms of a text, their weights scaled to length 1, and the part of its TF-IDF length that tells of the label."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        at = at[hit]
        plain = (1 + np.log(counts[hit])) * self.idf[at]
        weight = plain * self.relevance[at]
        length = np.sqrt(np.sum(weight * weight))
        if not length:
            return at[:0], weight[:0], 0.0
        return at, weight / length, float(length / np.sqrt(np.sum(plain * plain)))

    def summed(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sums of the common terms of some texts, given as (terms, weights), for all examples: texts x places."""
        dense = np.zeros((len(queries), len(self.rows)), np.float32)
        for i, (at, weight) in enumerate(queries):
            row = self.common[at]
            dense[i, row[row >= 0]] = weight[row >= 0]
        return dense @ self.rows

    def nearest(
        self, at: np.ndarray, weight: np.ndarray, k: int, skip: int = -1, summed: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of positive cosine, nearest first, ties to the first place."""
        summed = self.summed([(at, weight)])[0] if summed is None else summed
        rare = self.common[at] < 0
        at, weight = at[rare], weight[rare]
        entries = _ranges(self.first[at], self.first[at + 1])
        weight = np.repeat(weight, self.first[at + 1] - self.first[at])
        block = self.block[entries]
        bounds = np.bincount(block, weight * self.block_max[entries], minlength=len(self.labels))
        bounds = bounds + summed.reshape(self.labels.shape).max(axis=1)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        found, score = np.zeros(0, np.int64), np.zeros(0)
        # the blocks of the highest bounds first; then, at once, all that can still beat the k-th
        for part in (slice(None, _FIRST_BLOCKS), slice(_FIRST_BLOCKS, None)):
            least = score[k - 1] if len(score) >= k else 0.0
            blocks = order[part]
            blocks = blocks[bounds[blocks] * (1 + 1e-5) >= least]
            if not len(blocks):
                continue
            wanted = np.zeros(len(self.labels), bool)
            wanted[blocks] = True
            mine = wanted[block]
            start, end = self.start[entries[mine]], self.start[entries[mine] + 1]
            here = _ranges(start, end)
            cosine = np.bincount(self.example[here], np.repeat(weight[mine], end - start) * self.value[here], minlength=self.labels.size)
            cosine = cosine + summed
            places = np.flatnonzero(wanted.repeat(BLOCK) & (cosine > 0) & (cosine >= least))
            places = places[places != skip]
            found, score = np.concatenate([found, places]), np.concatenate([score, cosine[places]])
            best = np.lexsort((found, -score))[:k]
            found, score = found[best], score[best]
        return found, score

    def vote(self, found: np.ndarray, cosine: np.ndarray, share: float, doubt: float | None = None) -> float:
        """Share of label 1 among the neighbours, weighted by nearness, with the pseudo-vote against them."""
        near = cosine.astype(float) * share
        against = self.k * (self.doubt if doubt is None else doubt)
        if not near.sum() + against:
            return self.share_of_ones
        return float((near @ (self.labels.reshape(-1)[found] == 1) + against * self.share_of_ones) / (near.sum() + against))

    @property
    def share_of_ones(self) -> float:
        return float(np.count_nonzero(self.labels == 1) / max(1, np.count_nonzero(self.labels >= 0)))

    def score(self, found: np.ndarray, cosine: np.ndarray, share: float) -> float:
        """Calibrated probability of label 1; the prior where there are no neighbours."""
        if self.curve is None or not len(found):
            return self.prior
        return float(_probability(np.array(self.vote(found, cosine, share)), self.curve))


def _relevance(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Squared correlation (phi) with the label, for terms that so many examples of either label have."""
    both = ones + zeros
    return (ones * (n0 - zeros) - zeros * (n1 - ones)) ** 2.0 / np.maximum(both * (n1 + n0 - both) * float(max(1, n1)) * max(1, n0), 1)


def _probability(votes: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(votes * curve[0] + curve[1], -30, 30)))


def _label_weights(labels: np.ndarray, prior: float) -> np.ndarray:
    """Weights by which the two labels stand as in all learn rows."""
    return np.where(labels == 1, prior / np.mean(labels), (1 - prior) / np.mean(1 - labels))


def _calibrated(votes: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Logistic curve from votes to labels."""
    w = _label_weights(labels, prior)
    x = np.stack([votes, np.ones_like(votes)], axis=-1)
    beta = np.zeros(2)
    penalty = 1e-2 * np.eye(2)
    for _ in range(100):
        p = _probability(votes, beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (labels - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _loss(votes: np.ndarray, labels: np.ndarray, prior: float) -> float:
    p = _probability(votes, _calibrated(votes, labels, prior))
    return float(-np.mean(_label_weights(labels, prior) * np.log(np.where(labels == 1, p, 1 - p))))


def _indexed(counts: list, y: np.ndarray, ids: np.ndarray, terms: np.ndarray, idf: np.ndarray, prior: float, k: int) -> ExampleIndex:
    """Index over examples given as (term hashes, counts), for the terms of all examples."""
    sizes = np.array([len(c[0]) for c in counts])
    of = np.repeat(np.arange(len(counts)), sizes)
    where = np.searchsorted(terms, np.concatenate([c[0] for c in counts]))
    have = [np.bincount(where[y[of] == x], minlength=len(terms)) for x in (0, 1)]
    relevance = _relevance(have[1], have[0], int(np.sum(y == 1)), int(np.sum(y == 0)))
    value = (1 + np.log(np.concatenate([c[1] for c in counts]))) * (idf * relevance)[where]
    value /= np.maximum(np.sqrt(np.bincount(of, value * value, minlength=len(counts))), 1e-12)[of]
    # blocks of like examples have tight bounds: order by label and main term
    heaviest = np.lexsort((where, -value, of))
    main = np.full(len(counts), -1)
    main[of[heaviest][::-1]] = where[heaviest][::-1]
    place = np.lexsort((main, y))
    new = np.empty(len(place), np.int64)
    new[place] = np.arange(len(place))
    blocks = -(-len(y) // BLOCK)
    marks = np.full(blocks * BLOCK, -1, np.int64)
    marks[: len(y)] = y[place]
    example = new[of]
    order = np.lexsort((example, where))
    term, example, value = where[order], example[order], value[order].astype(np.float32)
    start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)]))
    first = np.searchsorted(term[start], np.arange(len(terms) + 1))
    return ExampleIndex(
        terms, idf, relevance, first, example[start] // BLOCK, np.maximum.reduceat(value, start), np.append(start, len(term)),
        example, value, marks.reshape(blocks, BLOCK), ids[place], prior, k,
    )


def _document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each index term stands, and the number of documents. One row per term reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = term_counts(text)[0]
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                total[at[terms[at] == hashes]] += 1
            total[-1] += batch.num_rows
        here = np.flatnonzero(total)
        yield pa.record_batch([pa.array(here), pa.array(total[here])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(terms) + 1, np.int64)
    total[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return total[:-1], int(total[-1])


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, k: int = K
) -> ExampleIndex:
    """Index of the examples among `labels` (doc_id, toxic) that `learn` marks, with texts from `docs`."""
    marked = labels.filter(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    # the first of each label, found in parts and then among the first of the parts
    marked = marked.withColumn("order", F.xxhash64("doc_id"))
    chosen = marked.withColumn("part", F.pmod("order", F.lit(_PARTS)))
    for keys in (["toxic", "part"], ["toxic"]):
        order = Window.partitionBy(*keys).orderBy("order", "doc_id")
        chosen = chosen.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_class).drop("nth")
    # two labels with at most per_class ids each, an id with several texts by one of them
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("one"))
    rows = rows.select("doc_id", F.col("one.text").alias("text"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i].astype(np.int64).tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["doc_id", "toxic", "terms", "counts"])

    made = rows.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(
        run, "doc_id long, toxic int, terms binary, counts binary"
    )
    examples = made.toArrow().to_pylist()
    examples.sort(key=lambda r: (r["toxic"], r["doc_id"], r["terms"]))
    y = np.array([r["toxic"] for r in examples])
    counts = [(np.frombuffer(r["terms"], np.int64).view(np.uint64), np.frombuffer(r["counts"], np.int64)) for r in examples]
    if len(set(y)) < 2 or not sum(len(c[0]) for c in counts):
        none, zero = np.zeros(0), np.zeros(0, np.int64)
        return ExampleIndex(zero.astype(np.uint64), none, none, np.zeros(1, np.int64), zero, none, np.zeros(1, np.int64), zero, none, np.zeros((0, BLOCK)), zero, prior, k)
    ids = np.array([r["doc_id"] for r in examples])
    terms = np.unique(np.concatenate([c[0] for c in counts]))
    df, n = _document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    index = _indexed(counts, y, ids, terms, idf, prior, k)
    # each fold, dealt by text, is judged by the others
    fold = np.array([zlib.crc32(c[0].tobytes()) % _FOLDS for c in counts])
    judged = []
    for part in range(_FOLDS):
        rest, mine = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
        if len(set(y[rest])) < 2 or not sum(len(counts[e][0]) for e in rest):
            continue
        others = _indexed([counts[e] for e in rest], y[rest], ids[rest], terms, idf, prior, k)
        for e in mine:
            at, weight, share = others.query(*counts[e])
            found, cosine = others.nearest(at, weight, k)
            judged.append((y[e], [others.vote(found, cosine, share, doubt) for doubt in DOUBTS]))
    truth = np.array([j[0] for j in judged])
    if len(set(truth)) == 2:
        votes = np.array([j[1] for j in judged])
        best = min(range(len(DOUBTS)), key=lambda i: _loss(votes[:, i], truth, prior))
        index.doubt, index.curve = DOUBTS[best], _calibrated(votes[:, best], truth, prior)
    return index


def scored(docs: DataFrame, index: ExampleIndex, keep: list[str], k: int = K) -> DataFrame:
    """The columns `keep` of every row with score and evidence (ids of the nearest examples, nearest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    given = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = [*keep, "score", "evidence"]
        for batch in batches:
            score, evidence = np.zeros(batch.num_rows), []
            for begin in range(0, batch.num_rows, _TEXTS):
                texts = batch.column(len(keep)).slice(begin, _TEXTS).to_pylist()
                queries = [index.query(*term_counts(t)) for t in texts]
                summed = index.summed([(at, weight) for at, weight, _ in queries])
                for i, (at, weight, share) in enumerate(queries):
                    found, cosine = index.nearest(at, weight, k, summed=summed[i])
                    score[begin + i] = index.score(found, cosine, share)
                    evidence.append(index.ids[found[:3]].tolist())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], names=names)

    schema = given.select(*keep).schema.add("score", "double").add("evidence", T.ArrayType(T.LongType()))
    return given.mapInArrow(run, schema)

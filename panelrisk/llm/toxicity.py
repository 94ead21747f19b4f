"""Toxicity by a counterfactually regularised classifier (operator 4).

A logistic model over the presence of words and word beginnings. It is fitted on a bounded
sample of labelled documents; each sampled document that names a group of people also
stands in the sample with the group swapped for others, and the fit penalises the squared
change of the score between the two. So a group's name cannot carry a score by itself.

Features are counted on Spark (one row per feature and batch before the shuffle); those
that set the classes apart most clearly are kept, and the sampled documents come to the
driver as lists of kept features only. Scoring is a map over all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.tables import texts

#: Bounds of the fit: labelled documents per class, and features kept.
ROWS_PER_CLASS = 8_000
MAX_FEATURES = 4_000
#: A feature must be seen in so many sampled documents and differ by so many standard errors.
MIN_DOCS, MIN_Z = 5, 3.0
RIDGE, COUNTERFACTUAL = 3e-4, 1.0

#: Names of groups, by kind; a name is swapped for the others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "american"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("teacher", "nurse", "farmer", "lawyer", "engineer"),
    ("teachers", "nurses", "farmers", "lawyers", "engineers"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SWAPS = {t: [o for o in row if o != t] for row in IDENTITY_TERMS for t in row}


def word_features(word: str):
    """A word itself and its beginnings of four and five letters."""
    if len(word) < 4:
        return (word,)
    if len(word) < 6:
        return (word, word[:4] + "*")
    return (word, word[:4] + "*", word[:5] + "*")


def _words(text: str):
    return set(_WORD.findall(text.lower()))


def _features(words):
    return {f for w in words for f in word_features(w)}


def swapped(words):
    """The document's words with each group name exchanged, once per turn of the row."""
    named = [w for w in words if w in _SWAPS]
    if not named:
        return []
    turns = max(len(_SWAPS[w]) for w in named)
    return [{_SWAPS[w][i % len(_SWAPS[w])] if w in _SWAPS else w for w in words}
            for i in range(turns)]


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS):
    """(text, toxic) of at most ``rows_per_class`` labelled documents a class, and label counts.

    Chosen by a hash of the id, so the choice does not follow the order of the table.
    The chosen ids are broadcast; their number is bounded.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r.n for r in
              known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(rows_per_class) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    return texts(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic"), counts


def _count_features(batches):
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(),
                               batch.column("toxic").to_pylist()):
            counts[toxic].update(_features(_words(text)))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[0][f] for f in names], pa.int64()),
             pa.array([counts[1][f] for f in names], pa.int64())], ["feature", "clean", "toxic"])


def choose_features(sample: DataFrame, n0: int, n1: int, most: int = MAX_FEATURES):
    """Features whose share differs most between the classes, in standard errors."""
    counted = sample.mapInArrow(_count_features, "feature string, clean long, toxic long") \
        .groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")) \
        .filter(F.col("c") + F.col("t") >= MIN_DOCS)
    p, q = F.col("t") / n1, F.col("c") / n0
    both = (F.col("t") + F.col("c")) / (n0 + n1)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + F.lit(1e-12))
    return [r.feature for r in counted.withColumn("z", z).filter(F.col("z") >= MIN_Z)
            .orderBy(F.col("z").desc(), "feature").limit(most).collect()]


def _indexed(index):
    """Rows (toxic, list of features, lists of features of the swapped documents)."""

    def run(batches):
        def pick(words):
            return sorted({index[f] for f in _features(words) if f in index})

        for batch in batches:
            own, other = [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                own.append(pick(words))
                other.append([pick(x) for x in swapped(words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(own, pa.list_(pa.int32())),
                 pa.array(other, pa.list_(pa.list_(pa.int32())))], ["toxic", "own", "other"])

    return run


class _Sparse:
    """Rows of feature numbers with the two products that the fit needs."""

    def __init__(self, rows, width):
        self.n, self.width = len(rows), width
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def dot(self, w):
        return np.bincount(self.at, w[self.col], self.n)

    def back(self, g):
        return np.bincount(self.col, g[self.at], self.width)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows, width, counts, ridge=RIDGE, counterfactual=COUNTERFACTUAL, steps=400):
    """(weights, intercept) by accelerated gradient steps.

    ``rows`` are (toxic, own features, features of swapped copies). Documents weigh such
    that the classes have the shares of all labels. The loss is the mean log loss plus
    ``counterfactual`` times the mean squared score change of swapped pairs plus a ridge.
    """
    y = np.array([r[0] for r in rows], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / n[1], counts.get(0, 0) / n[0])
    weight /= weight.sum()
    x = _Sparse([r[1] for r in rows], width)
    pairs = [(r[1], o) for r in rows for o in r[2]]
    a, b = (_Sparse([p[i] for p in pairs], width) for i in (0, 1))
    share = min(max(float(weight[y == 1].sum()), 1e-6), 1 - 1e-6)
    w, c = np.zeros(width), np.log(share / (1 - share))
    vw, vc, mw, mc = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(1, steps + 1):
        p = _sigmoid(x.dot(w) + c)
        g = weight * (p - y)
        gw, gc = x.back(g) + ridge * w, g.sum()
        if pairs:
            pa_, pb = _sigmoid(a.dot(w) + c), _sigmoid(b.dot(w) + c)
            d = 2 * counterfactual * (pa_ - pb) / len(pairs)
            ga, gb = d * pa_ * (1 - pa_), d * pb * (1 - pb)
            gw, gc = gw + a.back(ga) - b.back(gb), gc + (ga - gb).sum()
        mw, mc = 0.9 * mw + 0.1 * gw, 0.9 * mc + 0.1 * gc
        vw, vc = 0.999 * vw + 0.001 * gw * gw, 0.999 * vc + 0.001 * gc * gc
        fix1, fix2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w = w - 0.05 * (mw / fix1) / (np.sqrt(vw / fix2) + 1e-8)
        c = c - 0.05 * (mc / fix1) / (np.sqrt(vc / fix2) + 1e-8)
    return w, float(c)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS,
          max_features: int = MAX_FEATURES, counterfactual: float = COUNTERFACTUAL):
    """({feature: weight}, intercept). Without labels of both classes only the intercept."""
    sample, counts = training_sample(docs, labels, rows_per_class)
    n0, n1 = (min(counts.get(c, 0), rows_per_class) for c in (0, 1))
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if not n0 or not n1:
        return {}, float(np.log(share / (1 - share)))
    names = choose_features(sample, n0, n1, max_features)
    index = {f: i for i, f in enumerate(names)}
    rows = [(r.toxic, r.own, r.other) for r in sample.mapInArrow(
        _indexed(index), "toxic int, own array<int>, other array<array<int>>").collect()]
    if not names or not rows:
        return {}, float(np.log(share / (1 - share)))
    w, c = fit(rows, len(names), counts, counterfactual=counterfactual)
    return {f: float(w[i]) for f, i in index.items()}, c


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                   **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Labels of held-out ids are never learned from; a NULL or other label counts as none,
    repeated labels as toxic if one is. A NULL or empty text has the score of a text
    without features. Only the text is scored. Whole texts are read. An empty table
    gives no rows. The fit runs when this is called.
    """
    weights, intercept = train(docs, labels, **options)
    heads = {f[:4] for f in weights}
    shared = docs.sparkSession.sparkContext.broadcast((weights, heads))

    def run(batches):
        weights, heads = shared.value
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                hit = [w for w in _words(text) if w[:4] in heads]
                total = sum(weights.get(f, 0.0) for f in sorted(_features(hit)))
                scores.append(float(_sigmoid(total + intercept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    base = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

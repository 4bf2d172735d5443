"""Quality classifier by co-training of two views.

One view sees a text's content: which of the sample's telling words occur, and its style (shares of symbols,
capitals, digits and separators, repetition of words and lines, lengths of words and lines). The other sees the
page's metadata: source, language and recorded length. Each is a logistic regression fitted on the labelled sample.
In each round every view scores the unlabelled pool and hands its most confident documents, as pseudo-labels of
weight `trust`, to the other view, in proportion to the labels' classes; then both are fitted anew. At last each view
is calibrated by Platt scaling on out-of-fold scores, and a logistic regression on both calibrated logits combines them;
its weights are not negative, so a view that tells nothing gets no say. Telling words are chosen anew in each fold.

A document is good if its quality label is 1 and its toxic label is not 1. The model is fitted on a bounded sample: the
`most_labelled` labelled documents with the smallest hash of their id, and as a pool without labels the `most_pool` next
ones that are not among them, whether they have a label or not; documents that would bring the sample over `most_chars`
characters are left out. All documents are scored on their whole text.

Null and empty texts have no words and are scored by their style and metadata; null metadata is a value of its own.
Ids that are labelled twice count with their worst label; labels without a document, and null labels, are ignored.
With fewer than two labelled classes the score is the labels' mean, or 1 without any label, so nothing is rejected.
Repeated rows get equal scores; empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s]")
STYLE = 16
#: Buckets for the metadata view's values.
BUCKETS = 256


def style(text: str) -> tuple[list[float], set[str]]:
    """Numbers about the text's form, and its set of lower-case words."""
    raw = text.split()
    words = WORD.findall(text)
    lowered = [w.lower() for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    n, m, size = max(1, len(raw)), max(1, len(words)), max(1, len(text))
    counts = Counter(lowered)
    bare = sum(1 for w in raw if not any(map(str.isalnum, w)))
    repeats = sum(1 for a, b in zip(raw, raw[1:], strict=False) if a == b)
    marks = Counter(SYMBOL.findall(text))
    ends = marks["."] + marks["!"] + marks["?"] + marks[","] + marks[";"] + marks[":"]
    symbols = sum(marks.values())
    return [
        1.0,
        np.log1p(len(raw)) / 8,
        bare / n,
        repeats / n,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(len, words)) / m / 10,
        symbols / n,
        (symbols - ends) / n,
        marks["!"] / n,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / m,
        sum(1 for w in words if w[0].isupper()) / m,
        sum(map(str.isdigit, text)) / size,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5,
        float(not words),
    ], set(counts)


def example(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple:
    """What training keeps of a document: its form and words, not its text. Words are one string of bytes, as sets of them take ten times the driver's memory."""
    numbers, words = style(text or "")
    return (numbers, " ".join(sorted(words)).encode()), source, lang, n_chars


class Sparse:
    """Rows of (column, value), for sums by row and by column."""

    def __init__(self, rows: list[list[tuple[int, float]]], width: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([x for r in rows for x, _ in r], np.int64)
        self.val = np.array([v for r in rows for _, v in r], np.float64)
        self.shape = len(rows), width

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Sparse:
        """The same from arrays of each row's columns and values."""
        out = cls([], width)
        out.row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
        out.col, out.val = (np.concatenate([x[k] for x in rows] or [np.zeros(0)]).astype(kind) for k, kind in ((0, np.int64), (1, np.float64)))
        out.shape = len(rows), width
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.shape[1])

    def squares(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val**2 * g[self.row], self.shape[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 150, start: np.ndarray | None = None, least: float = -np.inf) -> np.ndarray:
    """Weights by accelerated gradient steps, scaled by each column's curvature; all but the first are `least` or more."""
    w = np.zeros(x.shape[1]) if start is None else start
    ahead, t = w.copy(), 1.0
    per_row = np.maximum(1.0, np.bincount(x.row, np.ones(len(x.row)), x.shape[0]))
    scale = 1 / (0.25 * x.squares(weight * per_row) + ridge)  # a bound on the curvature that holds for all columns at once
    for _ in range(rounds):
        step = ahead - scale * (x.back(weight * (_sigmoid(x.dot(ahead)) - y)) + ridge * ahead)
        step[1:] = np.maximum(step[1:], least)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = step + (t - 1) / t2 * (step - w), step, t2
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    w = logistic(Sparse([[(0, 1.0), (1, float(v))] for v in z], 2), y, np.ones(len(y)), 1e-3, least=0.0)
    return float(w[0]), float(w[1])


class Model:
    """Two calibrated views and their combination."""

    def __init__(self, words: dict[str, int], content: np.ndarray, meta: np.ndarray, calibration: list[tuple[float, float]], mix: np.ndarray, constant: float | None = None):
        self.words, self.content, self.meta, self.calibration, self.mix, self.constant = words, content, meta, calibration, mix, constant

    @staticmethod
    def content_row(text: str | None, words: dict[str, int]) -> list[tuple[int, float]]:
        numbers, own = style(text or "")
        row = list(enumerate(numbers))
        hits = [words[w] for w in own.intersection(words)]
        return row + [(STYLE + h, 1.0) for h in hits]

    @staticmethod
    def meta_row(source: str | None, lang: str | None, n_chars: int | None) -> list[tuple[int, float]]:
        size = "none" if n_chars is None else str(int(np.log2(max(1, n_chars))))
        values = [f"source={source}", f"lang={lang}", f"size={size}"]
        return [(0, 1.0), *sorted({(1 + zlib.crc32(v.encode()) % BUCKETS, 1.0) for v in values})]

    def score(self, rows: list[tuple[str | None, str | None, str | None, int | None]]) -> np.ndarray:
        if self.constant is not None or not rows:
            return np.full(len(rows), self.constant or 0.0)
        a = Sparse([self.content_row(r[0], self.words) for r in rows], len(self.content)).dot(self.content)
        b = Sparse([self.meta_row(*r[1:]) for r in rows], len(self.meta)).dot(self.meta)
        (a0, a1), (b0, b1) = self.calibration
        return _sigmoid(self.mix[0] + self.mix[1] * (a0 + a1 * a) + self.mix[2] * (b0 + b1 * b))


def telling_words(texts: list[np.ndarray], y: np.ndarray, names: list[str], most: int, least: int) -> dict[str, int]:
    """The words whose presence tells most about the class, by the G-squared statistic. texts: the numbers of each one's words in `names`."""
    none = [np.zeros(0, np.int32)]
    of = lambda label: np.bincount(np.concatenate([x for x, g in zip(texts, y, strict=True) if bool(g) == label] or none), minlength=len(names)).tolist()
    bad, good = of(False), of(True)
    n_bad, n_good = max(1, int((1 - y).sum())), max(1, int(y.sum()))

    def gain(w: int) -> float:
        a, b = bad[w], good[w]
        share = (a + b) / (n_bad + n_good)
        part = lambda k, n: (k * np.log(k / (n * share)) if k else 0.0) + ((n - k) * np.log((n - k) / (n * (1 - share))) if n > k else 0.0)
        return float(part(a, n_bad) + part(b, n_good)) if share < 1 else 0.0

    ranked = sorted(((-gain(i), w) for i, w in enumerate(names) if bad[i] + good[i] >= max(1, least)))
    return {w: i for i, (g, w) in enumerate(ranked[:most]) if -g > 5}


def train(labelled: list[tuple], y: np.ndarray, pool: list[tuple], *, rounds: int = 3, exchange: int = 200, trust: float = 0.3, folds: int = 4, most_words: int = 2000) -> Model:
    """labelled and pool: made by example(). y: 1 for good documents."""
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros(0), np.zeros(0), [], np.zeros(3), float(y.mean()) if len(y) else 1.0)
    number: dict[str, int] = {}
    seen, seen_pool = ([(np.array(r[0][0]), np.array([number.setdefault(w, len(number)) for w in r[0][1].decode().split()], np.int32)) for r in rows] for rows in (labelled, pool))
    names = list(number)
    known_meta, other_meta = ([tuple(np.array(x) for x in zip(*Model.meta_row(*r[1:]), strict=True)) for r in rows] for rows in (labelled, pool))
    ridges = (0.3, 3.0)

    def content(some: list[tuple[np.ndarray, np.ndarray]], words: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        place = np.full(len(names), -1, np.int32)
        place[[number[w] for w in words]] = list(words.values())
        out = []
        for numbers, own in some:
            hits = place[own]
            hits = np.sort(hits[hits >= 0])
            out.append((np.concatenate((np.arange(STYLE, dtype=np.int32), STYLE + hits)), np.concatenate((numbers, np.ones(len(hits))))))
        return out

    def co_train(train_at: np.ndarray) -> tuple[dict[str, int], list[np.ndarray]]:
        """Telling words, and weights of both views after the exchanges."""
        target = y[train_at]
        own = [seen[i] for i in train_at.tolist()]
        words = telling_words([x for _, x in own], target, names, most_words, max(3, len(target) // 1000))
        known = content(own, words), [known_meta[i] for i in train_at.tolist()]
        other = content(seen_pool, words), other_meta
        widths = STYLE + len(words), 1 + BUCKETS
        given: list[dict[int, float]] = [{}, {}]  # per view: pseudo-labels of pool places, from the other one
        weights: list[np.ndarray | None] = [None, None]
        for r in range(rounds + 1):
            for v in (0, 1):
                rows = known[v] + [other[v][i] for i in given[v]]
                labels = np.concatenate((target, np.array(list(given[v].values()))))
                trusts = np.concatenate((np.ones(len(target)), np.full(len(given[v]), trust)))
                weights[v] = logistic(Sparse.of(rows, widths[v]), labels, trusts, ridges[v], 60 if r else 150, weights[v])
            if r == rounds or not pool:
                return words, weights
            for v in (0, 1):
                p = _sigmoid(Sparse.of(other[v], widths[v]).dot(weights[v]))
                free = [i for i in np.argsort(-np.abs(p - 0.5), kind="stable").tolist() if i not in given[1 - v]]
                for label, share in ((1.0, target.mean()), (0.0, 1 - target.mean())):
                    sure = [i for i in free if (p[i] if label else 1 - p[i]) >= 0.95]
                    given[1 - v].update(dict.fromkeys(sure[: max(1, round(exchange * share))], label))
        return words, weights

    fold = np.arange(len(y)) % folds
    out = np.zeros((len(y), 2))
    for k in range(folds):
        words, weights = co_train(np.flatnonzero(fold != k))
        test = np.flatnonzero(fold == k)
        rows = content([seen[i] for i in test.tolist()], words), [known_meta[i] for i in test.tolist()]
        for v in (0, 1):
            out[test, v] = Sparse.of(rows[v], len(weights[v])).dot(weights[v])
    calibration = [_platt(out[:, v], y) for v in (0, 1)]
    z = np.stack([b0 + b1 * out[:, v] for v, (b0, b1) in enumerate(calibration)], axis=1)
    mix = logistic(Sparse([[(0, 1.0), (1, a), (2, b)] for a, b in z.tolist()], 3), y, np.ones(len(y)), 1e-2, least=0.0)
    words, (own_content, own_meta) = co_train(np.arange(len(y)))
    return Model(words, own_content, own_meta, calibration, mix)


#: The columns of text, two values of any kind, and length.
COLUMNS = ("text", "source", "lang", "n_chars")


def _own(docs: DataFrame, id_col: str, columns: tuple[str, str, str, str]) -> DataFrame:
    text, source, lang, size = (docs[x] for x in columns)
    return docs.select(docs[id_col].alias("id"), text.alias("text"), source.cast("string").alias("source"), lang.cast("string").alias("lang"), size.cast("long").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 6000, most_pool: int = 1500, most_chars: int = 40_000_000, id_col: str = "doc_id", columns: tuple[str, str, str, str] = COLUMNS, **settings) -> Model:
    """Model of a bounded sample: by number of documents, and by characters, so that the driver's memory is bounded."""
    c.tune(docs.sparkSession)
    key = F.xxhash64(F.col("id").cast("string"))
    good = F.min(F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 0).otherwise(F.col("quality"))).alias("good")
    judged = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(good)
    ids = docs.select(docs[id_col].alias("id")).distinct()
    chosen = judged.join(ids, "id").orderBy(key, "id").limit(most_labelled)
    known, _ = c.saved(chosen.select("id", F.col("good").cast("int").alias("good")), "quality-labels")
    # the pool: the first ids beyond the sample's, found among the first most_labelled + most_pool of all
    first = ids.orderBy(key, "id").limit(most_labelled + most_pool).join(known, "id", "left_anti")
    pool = first.orderBy(key, "id").limit(most_pool).withColumn("good", F.lit(None).cast("int"))
    picked = F.broadcast(known.union(pool))  # most_labelled + most_pool rows
    rows = _own(docs, id_col, columns).join(picked, "id").dropDuplicates(["id"])
    held, size = [], 0
    for r in rows.orderBy(F.col("good").isNull(), key, "id").toLocalIterator():
        n = len(r["text"] or "")
        if size + n <= most_chars:
            size += n
            held.append((example(r["text"], r["source"], r["lang"], r["n_chars"]), r["good"]))
    known_rows = [x for x, g in held if g is not None]
    return train(known_rows, np.array([float(g) for _, g in held if g is not None]), [x for x, g in held if g is None], **settings)


def _scores(batch: pa.RecordBatch, own: Model, columns: tuple[str, ...] = COLUMNS) -> np.ndarray:
    out = np.empty(batch.num_rows)
    at = 0
    for part in c.pieces_of(iter([batch]), columns[0], 1 << 20):
        values = [part.column(part.schema.get_field_index(x)).to_pylist() for x in columns]
        values[1:3] = ([None if v is None else str(v) for v in x] for x in values[1:3])
        out[at : at + part.num_rows] = own.score(list(zip(*values, strict=True)))
        at += part.num_rows
    return out


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """(id, score) of each row: the probability that the document is good."""
    c.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b, own), pa.float64())], ["id", "score"])

    one = c.spread(_own(docs, id_col, columns))
    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.5, columns: tuple[str, str, str, str] = COLUMNS) -> DataFrame:
    """The rows of docs that score at least the threshold, in one pass without a shuffle."""
    c.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**sent.value)
        for b in batches:
            yield b.filter(pa.array(_scores(b, own, columns) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document, and whether it is kept."""
    docs = c.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, c.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("keep"))

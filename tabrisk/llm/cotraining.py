"""Quality by co-training two views of a document.

The text view has the words, punctuation marks and word statistics of the
content; the metadata view has source, language, length, lines and
character-class shares of the page.  Each view has a linear classifier.

All unlabelled documents take part.  Their features are written once; in every
round one Spark pass scores each of them with both views and adds up
histograms of confidence, from which the cuts are taken, and a second one hands
the rows above one view's cut, as pseudo-labels, to the other view: each task
adapts that view's weights to the rows it holds, and the tasks' weights are
averaged by rows (iterative parameter mixing).  The average is the prior mean
from which the view is fitted to the labelled rows again.  At the end both
views are calibrated on labelled rows that no fit has seen, and the combined
logits score every document.

Only labelled rows reach the driver: at most about ``max_rows``, counted as
distinct rows and not as ids.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import linear, pairing, quality_rules, textscan, toxicity
from tabrisk.llm.spark_util import labelled_sample, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
for _module in (linear, pairing, quality_rules, toxicity):
    cloudpickle.register_pickle_by_value(_module)

#: Labelled rows that a fit may take, and the part of them kept for calibration (one in ...).
MAX_ROWS, HELD = 8000, 4
ROUNDS = 2
#: Share of the unlabelled rows that a view hands over in a round, and its least confidence.
GROW, SURE = 0.1, 0.9
#: Features of a view (the most frequent of the labelled rows), bins of confidence,
#: rows adapted to at a time, steps, and the pull back to the shared weights.
FEATURES, BINS, CHUNK, STEPS, PULL = 32_768, 2000, 20_000, 20, 0.05
TEXT_DENSE, META_DENSE = 4, 12
HASHED_META = 16


def text_view(data: np.ndarray, offsets: np.ndarray):
    """(hash, document) of words and punctuation runs, and dense statistics:
    distinct share, repeated share, mean length, words (log)."""
    n = len(offsets) - 1
    starts, ends, h, doc = textscan.words(data, offsets, textscan.ALNUM)
    _, _, h2, d2 = textscan.words(data, offsets, textscan.PUNCT)
    words = np.bincount(doc, minlength=n)
    key = np.unique(h ^ textscan.mix(doc.astype(np.uint64) + np.uint64(7)), return_index=True)[1]
    distinct = np.bincount(doc[key], minlength=n)
    repeat = quality_rules.repeated_words(h, doc, n, 3)
    some = np.maximum(words, 1)
    dense = np.stack([distinct / some, repeat / some, np.bincount(doc, ends - starts, n) / some / 10,
                      np.log1p(words) / 10], axis=1)
    return np.concatenate([h, h2]), np.concatenate([doc, d2]), dense


def meta_view(data: np.ndarray, offsets: np.ndarray, source: list, lang: list):
    """(hash, document) of source and language, and dense layout statistics."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: quality_rules.per_text(mask, offsets) / size
    lines = quality_rules.per_text(data == 0x0A, offsets) + 1
    last = data[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(n, np.uint8)
    upper, lower = share((data >= 0x41) & (data <= 0x5A)), share((data >= 0x61) & (data <= 0x7A))
    dense = np.stack([np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 5, upper, lower,
                      share((data >= 0x30) & (data <= 0x39)), share(data >= 0x80), share(quality_rules.SPACE[data]),
                      share(textscan.PUNCT[data]), share(quality_rules.SYMBOLS[data]),
                      np.isin(last, [0x21, 0x2E, 0x3F]).astype(float), upper / (upper + lower + 0.01)], axis=1)
    hashes = [[textscan.word_hash(f"{k}={v}") for v in col] for k, col in (("source", source), ("lang", lang))]
    return np.array(hashes, np.uint64).reshape(-1), np.tile(np.arange(n), 2), dense


def lists(h: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct features of each document."""
    order = np.lexsort([h, doc])
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.split(h[new].view(np.int64), np.searchsorted(doc[new], np.arange(1, n)))


@dataclass
class CoTrained:
    """Fitted views, their dense scales, calibration (a, b of each view),
    and the cut on the combined probability."""
    views: list
    scales: list
    calibration: np.ndarray
    threshold: float

    def combine(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities by view, and combined (mean of logits)."""
        logits = margins * self.calibration[:, 0] + self.calibration[:, 1]
        return linear.sigmoid(logits), linear.sigmoid(logits.mean(axis=1))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * margin + b) by Newton steps with a weak prior."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    p = np.array([1.0, 0.0])
    for _ in range(30):
        q = linear.sigmoid(x @ p)
        grad = x.T @ (q - y) + 0.1 * (p - [1.0, 0.0])
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
        p = p - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(p[0], 1e-3)), float(p[1])


@dataclass
class View:
    """Sparse rows in a view's feature numbers and scaled dense statistics."""
    offsets: np.ndarray
    features: np.ndarray
    dense: np.ndarray

    def __len__(self):
        return len(self.offsets) - 1

    def margin(self, w: np.ndarray) -> np.ndarray:
        d = self.dense.shape[1]
        own = np.repeat(np.arange(len(self)), np.diff(self.offsets))
        return w[-1] + np.bincount(own, w[self.features], len(self)) + self.dense @ w[len(w) - 1 - d: -1]

    def take(self, at: np.ndarray) -> "View":
        flat, own = pairing.ranges(self.offsets[at], np.diff(self.offsets)[at])
        return View(np.searchsorted(own, np.arange(len(at) + 1)), self.features[flat], self.dense[at])

    def gradient(self, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Mean gradient of the log-loss at w (features, dense part, bias)."""
        g = (linear.sigmoid(self.margin(w)) - y) / max(len(self), 1)
        d = self.dense.shape[1]
        own = np.repeat(np.arange(len(self)), np.diff(self.offsets))
        return np.concatenate([np.bincount(self.features, g[own], len(w) - 1 - d), self.dense.T @ g, [g.sum()]])


def descend(rows: View, y: np.ndarray, start: np.ndarray, pull: float, steps: int, free: np.ndarray | None = None) -> np.ndarray:
    """Adam from ``start`` on the log-loss, pulled back to ``start``; weights
    outside ``free`` stay.  Deterministic."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        grad = rows.gradient(w, y) + pull * (w - start)
        if free is not None:
            grad = grad * free
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return w


def fit_view(rows: View, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The view's weights from labelled rows, starting at the prior; only
    features that tell the classes apart leave it."""
    n = np.bincount(rows.features, minlength=len(prior) - 1 - rows.dense.shape[1]).astype(float)
    own = np.repeat(np.arange(len(rows)), np.diff(rows.offsets))
    pos = np.bincount(rows.features, y[own], len(n))
    share = y.mean() if len(y) else 0.0
    spread = np.maximum(n * share * (1 - share) * (1 - n / max(len(y), 1)), 1e-9)
    chi = np.where(n >= 2, (pos - n * share) ** 2 / spread, 0.0)
    free = np.append((chi > 3.84).astype(float), np.ones(rows.dense.shape[1] + 1))
    return descend(rows, y, prior, 1.0 / max(len(y), 1), 120, free)


def cut_of(counts: np.ndarray, most: int) -> float:
    """The least confidence handed over: at most ``most`` rows (whole bins from
    the top, one bin at least), and ``SURE`` at least.  Rows of a bin go together."""
    above = np.cumsum(counts[::-1])[::-1]
    ok = np.flatnonzero(above <= most)
    first = int(ok[0]) if len(ok) else BINS - 1
    if first and above[min(first, BINS - 1)] == 0:
        first = int(np.flatnonzero(counts)[-1]) if counts.any() else BINS - 1
    return max(SURE, first / BINS)


def view_columns(batch: pa.RecordBatch, scales) -> list[View]:
    dense = batch.column("d").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, TEXT_DENSE + META_DENSE)
    out = []
    for name, part, (mean, std) in (("t", slice(0, TEXT_DENSE), scales[0]), ("m", slice(TEXT_DENSE, None), scales[1])):
        col = batch.column(name)
        edges = np.asarray(col.offsets).astype(np.int64)
        out.append(View(edges - edges[0], col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), (dense[:, part] - mean) / std))
    return out


def confidences(rows: DataFrame, weights, scales) -> np.ndarray:
    """Numbers of rows by [giving view, label, bin of confidence] (broadcast weights)."""
    def run(batches):
        counts = np.zeros((2, 2, BINS), np.int64)
        for batch in batches:
            for j, view in enumerate(view_columns(batch, scales)):
                p = linear.sigmoid(view.margin(weights.value[j]))
                for label, sure in ((1, p), (0, 1 - p)):
                    counts[j, label] += np.bincount(np.minimum((sure * BINS).astype(int), BINS - 1), minlength=BINS)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*at.T, counts[counts > 0])], names=["view", "label", "bin", "n"])

    got = rows.mapInArrow(run, "view long, label long, bin long, n long").groupBy("view", "label", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 2, BINS), np.int64)
    out[tuple(got.column(c).to_numpy() for c in ("view", "label", "bin"))] = got.column("n").to_numpy()
    return out


def adapted(rows: DataFrame, weights, scales, cuts: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """{taking view: (pseudo-labelled rows, mean of the adapted weights)}."""
    def run(batches):
        held = [[], []]
        total = [(0, 0.0), (0, 0.0)]

        def learn(j):
            views, ys = zip(*held[j])
            flat = View(np.append(0, np.cumsum(np.concatenate([np.diff(v.offsets) for v in views]))),
                        np.concatenate([v.features for v in views]), np.concatenate([v.dense for v in views]))
            w = descend(flat, np.concatenate(ys), weights.value[j], PULL, STEPS)
            total[j] = (total[j][0] + len(flat), total[j][1] + len(flat) * w)
            held[j] = []

        for batch in batches:
            views = view_columns(batch, scales)
            for giver, taker in ((0, 1), (1, 0)):
                p = linear.sigmoid(views[giver].margin(weights.value[giver]))
                label = (p >= 0.5).astype(int)
                sure = np.where(label == 1, p, 1 - p)
                at = np.flatnonzero(sure >= cuts[giver][label])
                if len(at):
                    held[taker].append((views[taker].take(at), label[at].astype(float)))
                    if sum(len(y) for _, y in held[taker]) >= CHUNK:
                        learn(taker)
        for j in range(2):
            if held[j]:
                learn(j)
        some = [j for j in range(2) if total[j][0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([total[j][0] for j in some], pa.int64()),
             pa.array([total[j][1] for j in some], pa.list_(pa.float64()))], names=["view", "n", "w"])

    part = rows.mapInArrow(run, "view int, n long, w array<double>")
    got = part.groupBy("view").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("w")).alias("w")).collect()
    return {r["view"]: (r["n"], r["w"].toArray() / r["n"]) for r in got}


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> pa.Table:
    """Features of about ``max_rows`` distinct labelled rows of ``docs``: ids by
    their hash, and of many rows with few ids, rows by the hash of their content."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                   .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")))
    sample = labelled_sample(columns(docs, id_col, text_col), known, max_rows)

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column("text")):
                n = last - first
                part = batch.slice(first, n)
                h, doc, dense = text_view(data, offsets)
                g, d2, layout = meta_view(data, offsets, part.column("source").to_pylist(), part.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("content"), part.column("y"), pa.array(lists(h, doc, n), pa.list_(pa.int64())),
                     pa.array(lists(g, d2, n), pa.list_(pa.int64())),
                     pa.array(list(np.hstack([dense, layout])), pa.list_(pa.float64()))],
                    names=["content", "y", "t", "m", "d"])

    rows = sample.mapInArrow(run, "content long, y int, t array<long>, m array<long>, d array<double>").distinct()
    # equal rows count once; the limit holds even where many rows share a hash
    return rows.orderBy("content", "y", "m").limit(2 * max_rows).toArrow()


def unlabelled_rows(docs: DataFrame, labels: DataFrame, known: list, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Feature numbers (at most ``FEATURES`` of a view, so two bytes each) and
    dense statistics of every row without a label, written."""
    def run(batches):
        find = [toxicity.lookup(k.value) for k in known]
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column("text")):
                n = last - first
                part = batch.slice(first, n)
                h, doc, dense = text_view(data, offsets)
                g, d2, layout = meta_view(data, offsets, part.column("source").to_pylist(), part.column("lang").to_pylist())
                arrays = []
                for look, k, hashes, own in ((find[0], known[0].value, h, doc), (find[1], known[1].value, g, d2)):
                    at, feature = look(hashes)
                    hit = np.unique(own[at] * np.int64(max(len(k), 1)) + feature)
                    own, feature = np.divmod(hit, max(len(k), 1))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32)),
                                                           pa.array(feature.astype(np.int16))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *arrays, pa.array(list(np.hstack([dense, layout]).astype(np.float32)), pa.list_(pa.float32()))], names=["id", "t", "m", "d"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = columns(docs, id_col, text_col).mapInArrow(run, f"id {kind}, t array<short>, m array<short>, d array<float>")
    with_label = labels.where(F.col(label_col).cast("int").isin(0, 1)).select(F.col(id_col).alias("id")).distinct()
    return written(rows.join(with_label, "id", "left_anti").select("t", "m", "d"), "cotraining-rows")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on about ``max_rows`` labelled rows and all other rows of ``docs``.

    Of several labels of an id the smallest counts; labels of absent ids, null
    ids and labels other than 0 and 1 are not used; repeated rows of the sample
    count once.  Copies lie in the same part of the labelled rows.  Without
    labelled rows every score is the neutral one."""
    context = docs.sparkSession.sparkContext
    got = labelled_rows(docs, labels, id_col, text_col, label_col, max_rows)
    y = got.column("y").to_numpy().astype(float)
    held = got.column("content").to_numpy() % HELD == 0
    if held.all() or not held.any():
        held = np.arange(len(y)) % HELD == 0
    dense = np.array(got.column("d").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, TEXT_DENSE + META_DENSE)
    known, views, scales, weights = [], [], [], []
    for name, part in (("t", slice(0, TEXT_DENSE)), ("m", slice(TEXT_DENSE, None))):
        col = got.column(name).combine_chunks()
        edges, flat = np.asarray(col.offsets).astype(np.int64), col.flatten().to_numpy(zero_copy_only=False)
        hashes, df = np.unique(flat, return_counts=True)
        hashes = np.sort(hashes[np.lexsort([hashes, -df])[:FEATURES]][: int((df >= 2).sum())])
        at = np.minimum(np.searchsorted(hashes, flat), max(len(hashes) - 1, 0))
        ok = hashes[at] == flat if len(hashes) else np.zeros(len(flat), bool)
        own = np.repeat(np.arange(len(y)), np.diff(edges))[ok]
        d = dense[:, part]
        scales.append((d.mean(axis=0), d.std(axis=0) + 1e-6) if len(d) else (np.zeros(d.shape[1]), np.ones(d.shape[1])))
        views.append(View(np.searchsorted(own, np.arange(len(y) + 1)), at[ok], (d - scales[-1][0]) / scales[-1][1]))
        known.append(hashes)
        start = np.zeros(len(hashes) + d.shape[1] + 1)
        share = np.clip(y[~held].mean(), 1e-3, 1 - 1e-3) if (~held).any() else 0.5
        start[-1] = np.log(share / (1 - share))
        weights.append(start)
    if len(y):
        seen = np.flatnonzero(~held)
        seen_rows = [v.take(seen) for v in views]
        weights = [fit_view(v, y[seen], w) for v, w in zip(seen_rows, weights)]
        pool = unlabelled_rows(docs, labels, [context.broadcast(k) for k in known], id_col, text_col, label_col)
        n_pool = pool.count()
        for _ in range(rounds if n_pool else 0):
            sent = context.broadcast(weights)
            counts = confidences(pool, sent, scales)
            shares = [1 - y[seen].mean(), y[seen].mean()]
            cuts = np.array([[cut_of(counts[j, label], int(np.ceil(GROW * shares[label] * n_pool))) for label in (0, 1)] for j in range(2)])
            for j, (_, prior) in adapted(pool, sent, scales, cuts).items():
                weights[j] = fit_view(seen_rows[j], y[seen], prior)
    margins = np.stack([v.margin(w) for v, w in zip(views, weights)], axis=1) if len(y) else np.zeros((0, 2))
    calibration = np.array([platt(margins[held, j], y[held]) for j in range(2)])
    fitted = [linear.Linear(float(w[-1]), k, w[: len(k)], w[len(k): -1]) for w, k in zip(weights, known)]
    out = CoTrained(fitted, scales, calibration, 0.5)
    if held.any():
        # dropping a good row counts twice
        bad = 1 - out.combine(margins[held])[1]
        out.threshold = 1 - linear.best_threshold(bad, 1 - y[held], 2.0)
    return out


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_text, p_meta, p, kept) of every row of ``docs`` (columns source
    and lang are needed).

    Null source or language counts as an empty one; a null or empty text is
    never kept.  Repeated rows each get a row; extra columns are ignored; an
    empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        find = [toxicity.lookup(v.hashes) for v in model.views]
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column("text")):
                n = last - first
                part = batch.slice(first, n)
                views = [text_view(data, offsets),
                         meta_view(data, offsets, part.column("source").to_pylist(), part.column("lang").to_pylist())]
                margins = np.zeros((n, 2))
                for j, (h, doc, dense) in enumerate(views):
                    v, (m, s) = model.views[j], model.scales[j]
                    at, feature = find[j](h)
                    hit = np.unique(doc[at] * np.int64(max(len(v.hashes), 1)) + feature)
                    own, feature = np.divmod(hit, max(len(v.hashes), 1))
                    margins[:, j] = v.bias + np.bincount(own, v.weights[feature], n) + ((dense - m) / s) @ v.dense
                by_view, p = model.combine(margins)
                some = quality_rules.per_text(~quality_rules.SPACE[data], offsets) > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(by_view[:, 0]), pa.array(by_view[:, 1]), pa.array(p),
                     pa.array(some & (p >= model.threshold))], names=["id", "p_text", "p_meta", "p", "kept"])

    return (columns(docs, id_col, text_col)
            .mapInArrow(run, f"id {kind}, p_text double, p_meta double, p double, kept boolean").withColumnRenamed("id", id_col))

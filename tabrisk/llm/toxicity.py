"""Toxicity by a classifier chain.

Categories are predicted one after another: ``word`` (a marked whole word),
``stem`` (a marked word beginning, as in inflected forms), ``dense`` (marked
words are frequent) and ``toxic`` (the given label).  Each later linear model
gets the probabilities of the earlier categories as features; it is trained on
their out-of-fold predictions, and a fold's markers come from the other folds,
so it never learns from a probability that has seen the row's own label.

The label table has one label, ``toxic``; the earlier categories are weak
labels from it: a marker is a feature found in several toxic rows of the
training sample and in no clean one.

Fitting takes a bounded sample of labelled rows (``max_rows``, chosen by
hashes of ids and contents); scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import linear, textscan
from tabrisk.llm.spark_util import labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(linear)

#: Labelled rows that a fit may take.
MAX_ROWS = 6000
FOLDS = 3
CATEGORIES = ("word", "stem", "dense", "toxic")
#: Bytes of a word's beginning that are features of their own.
PREFIXES = (4, 5, 6)
_SALT = [np.uint64(0xA24BAED4963EE407 * (i + 1) % (1 << 64)) for i in range(1 + len(PREFIXES))]


def word_features(data, offsets):
    """For each feature kind (whole word, then word beginnings) the hash of
    each word's feature, and the words' documents."""
    starts, ends, h, doc = textscan.words(data, offsets, textscan.ALNUM)
    kinds = [h ^ _SALT[0]]
    for size, salt in zip(PREFIXES, _SALT[1:]):
        cut = np.minimum(ends, starts + size)
        x = textscan.span_hashes(data, starts, cut) ^ salt
        # a shorter word has no beginning of this size
        kinds.append(np.where(ends - starts > size, x, np.uint64(0)))
    return kinds, doc


def present(kinds, doc, n):
    """Sorted distinct features of each document, whole words' first bit clear
    and beginnings' first bit set (so that a feature tells its kind)."""
    out = []
    cuts = np.searchsorted(doc, np.arange(n + 1))
    top = np.uint64(1 << 63)
    flat = [k | top if i else k & ~top for i, k in enumerate(kinds)]
    for i in range(n):
        own = [k[cuts[i]: cuts[i + 1]] for k in flat]
        out.append(np.unique(np.concatenate(own)).view(np.int64))
    return out


@dataclass
class Chain:
    """Fitted models by category, and the cut on the last one's probability."""
    models: list
    threshold: float

    def tables(self):
        """(sorted hashes of all models, weights [hash, category])."""
        hashes = np.unique(np.concatenate([m.hashes for m in self.models] + [np.zeros(0, np.int64)]))
        weights = np.zeros((len(hashes), len(self.models)))
        for j, m in enumerate(self.models):
            weights[np.searchsorted(hashes, m.hashes), j] = m.weights
        return hashes, weights

    def follow(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities by category from the sums of present weights."""
        p = np.zeros((len(sums), len(self.models)))
        for j, m in enumerate(self.models):
            p[:, j] = linear.sigmoid(m.bias + sums[:, j] + p[:, :j] @ m.dense)
        return p


def weak_categories(rows: linear.Rows, toxic: np.ndarray, n_words: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """[row, category] 0/1 labels, the given label last; markers come from the
    rows ``seen`` (a mask) only."""
    owner = rows.owner
    pos = np.bincount(rows.features, (toxic * seen)[owner], len(rows.hashes))
    neg = np.bincount(rows.features, ((1 - toxic) * seen)[owner], len(rows.hashes))
    marker = (pos >= max(3, 0.005 * (toxic * seen).sum())) & (neg == 0)
    whole = rows.hashes >= 0
    hit = lambda which: np.bincount(owner, which[rows.features], len(rows)) * toxic
    words, stems = hit(marker & whole), hit(marker & ~whole)
    dense = 100 * (words + stems) >= n_words
    return np.stack([words > 0, stems > 0, dense & (words + stems > 0), toxic > 0], axis=1).astype(int)


def train(rows: linear.Rows, toxic: np.ndarray, n_words: np.ndarray, folds: int = FOLDS,
          fold: np.ndarray | None = None) -> Chain:
    """Fit the chain; the threshold makes the fewest errors out of fold.  A
    fold's models and their markers come from the other folds."""
    n, everything = len(rows), np.arange(len(rows))
    fold = everything % folds if fold is None else fold
    y = weak_categories(rows, toxic, n_words, np.ones(n, bool))
    without = [weak_categories(rows, toxic, n_words, fold != f) for f in range(folds)]
    oof = np.zeros((n, 0))
    models = []
    for j in range(y.shape[1]):
        out = np.zeros(n)
        for f in range(folds):
            held = np.flatnonzero(fold == f)
            model = linear.fit(rows, oof, without[f][:, j], np.flatnonzero(fold != f))
            out[held] = linear.sigmoid(model.margin(rows, oof)[held])
        models.append(linear.fit(rows, oof, y[:, j], everything))
        oof = np.column_stack([oof, out])
    return Chain(models, linear.best_threshold(oof[:, -1], y[:, -1], 2.0) if n else 0.5)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Chain:
    """Fit on about ``max_rows`` distinct rows of ``docs`` that ``labels`` names
    with a label of 0 or 1 (of several labels of an id the largest counts;
    labels of absent ids and rows without an id or a label are not used; equal
    rows count once).  Folds go by content, so copies are in one."""
    labels = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                    .where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    sample = labelled_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels, max_rows)
    sample = sample.select("content", "y", "text")

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column(2)):
                kinds, doc = word_features(data, offsets)
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                     pa.array(np.bincount(doc, minlength=n)),
                     pa.array(present(kinds, doc, n), pa.list_(pa.int64()))], names=["content", "y", "n", "x"])

    rows = sample.mapInArrow(run, "content long, y int, n long, x array<long>").distinct()
    # the limit holds even where many rows share a hash
    got = rows.orderBy("content", "n", "y", "x").limit(2 * max_rows).toArrow()
    x = got.column("x").combine_chunks()
    flat, at = x.flatten().to_numpy(zero_copy_only=False), np.asarray(x.offsets)
    lists = [flat[a - at[0]: b - at[0]] for a, b in zip(at[:-1], at[1:])]
    return train(linear.Rows.of(lists), got.column("y").to_numpy(), got.column("n").to_numpy(),
                 fold=got.column("content").to_numpy() % FOLDS)


def lookup(hashes: np.ndarray):
    """A function that finds which of many 64-bit values are among ``hashes``:
    a small bit table first, then an exact search for what passes it."""
    table = np.zeros(1 << 18, bool)
    table[(hashes.view(np.uint64) >> np.uint64(8)) & np.uint64(0x3FFFF)] = True

    def find(x: np.ndarray):
        maybe = np.flatnonzero(table[(x >> np.uint64(8)) & np.uint64(0x3FFFF)])
        v = x[maybe].view(np.int64)
        at = np.minimum(np.searchsorted(hashes, v), max(len(hashes) - 1, 0))
        ok = hashes[at] == v if len(hashes) else np.zeros(len(v), bool)
        return maybe[ok], at[ok]
    return find


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one probability for each category, rejected) of every row.

    A null or empty text has no feature and gets the bias probabilities; such
    a row is never rejected.  Repeated rows each get a row; extra columns are
    ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = scorer(chain)

    def rows(batches):
        for batch in batches:
            p, rejected = run(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, j]) for j in range(p.shape[1])], pa.array(rejected)],
                names=["id", *[f"p_{c}" for c in CATEGORIES], "rejected"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                .mapInArrow(rows, f"id {kind}, " + "".join(f"p_{c} double, " for c in CATEGORIES) + "rejected boolean")
                .withColumnRenamed("id", id_col))


def scorer(chain: Chain):
    """A function from a text column to (probabilities, rejected)."""
    hashes, weights = chain.tables()
    top = np.uint64(1 << 63)

    def run(column):
        n = len(column)
        sums, has_word = np.zeros((n, weights.shape[1])), np.zeros(n, bool)
        find = lookup(hashes)
        for first, last, data, offsets in textscan.slices(column):
            kinds, doc = word_features(data, offsets)
            has_word[first + np.unique(doc)] = True
            hits = []
            for i, k in enumerate(kinds):
                word, feature = find(k | top if i else k & ~top)
                hits.append(doc[word] * np.int64(max(len(hashes), 1)) + feature)
            hit = np.unique(np.concatenate(hits))
            doc_of, feature = np.divmod(hit, max(len(hashes), 1))
            for j in range(weights.shape[1]):
                sums[first:last, j] = np.bincount(doc_of, weights[feature, j] if len(feature) else None, last - first)
        p = chain.follow(sums)
        return p, has_word & (p[:, -1] >= chain.threshold)
    return run


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, all columns as they
    are, of any name; no shuffle.  Rows with null or empty texts and null ids
    stay; repeated rows have one decision; an empty table stays empty; a very
    long text is read whole, in linear time."""
    run = scorer(chain)
    at = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array(~run(batch.column(at))[1]))

    return docs.mapInArrow(clean, docs.schema)

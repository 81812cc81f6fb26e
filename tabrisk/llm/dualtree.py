"""Ranked lexical search by a dual tree.

All documents are ranked for each item by a sum over the item's terms of
term weight times the term's impact in the document, all in integers.

* One pass over the texts writes, for each document, its number of terms and
  the frequencies of the terms that some item has; corpus statistics are
  aggregates of that table.
* Documents become impact vectors, lie near others with the same heaviest
  terms (a range partitioning on those and the id's hash, so copies spread
  over partitions), and form a hierarchy in chunks: a node holds the largest
  impact of each term below it.  Items form a hierarchy in batches in the same
  way, with the largest term weights.
* The product of an item node's and a document node's maxima bounds every
  score below the pair.  Pairs are followed from the roots; one whose bound is
  under the weakest k-th score of its items is dropped with all below it, the
  leaves that stay are scored exactly.  The k-th scores start from a search
  over a bounded sample and rise as a task goes on.
* Each task returns its best k documents of an item; two salted rounds of
  ranks give the k best.

Items are taken in blocks of at most ``postings`` terms (or one larger item);
a block's vectors are broadcast, which that bounds.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm import textscan, toxicity
from tabrisk.llm.spark_util import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(toxicity)

TOP = 20
#: Terms of a block of items, documents that the first k-th scores come from.
POSTINGS, SEED_DOCS = 4_000_000, 20_000
#: Documents of a leaf, a node and a chunk; items of a leaf, a node and a batch.
DOC_LEAF, DOC_NODE, CHUNK = 16, 128, 1024
ITEM_LEAF, ITEM_NODE, BATCH = 8, 64, 256
#: Terms of a batch (or one larger item), and cells of a chunk's matrix.
BATCH_TERMS, CELLS = 32_768, 1 << 23
#: Bounds are doubles, raised by more than rounding can take from them.
UP = 1 + 1e-9
#: Parts that an item's candidates are ranked in first.
SALTS = 64


def term_counts(data: np.ndarray, offsets: np.ndarray):
    """Number of terms of each text, and (text, term hash) of all words."""
    _, _, h, doc = textscan.words(data, offsets, textscan.ALNUM)
    return np.bincount(doc, minlength=len(offsets) - 1), doc, h


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(item, term, times) of all items; ``items`` has a column ``item``."""
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column(1)):
                _, doc, h = term_counts(data, offsets)
                order = np.lexsort([h, doc])
                doc, h = doc[order], h[order]
                at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(doc[at])), pa.array(h[at].view(np.int64)),
                     pa.array(np.diff(np.append(at, len(h))))], names=["item", "term", "times"])

    return items.select("item", F.col(text_col).alias("text")).mapInArrow(run, "item long, term long, times long")


def document_terms(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, t, tf) of every document: its number of terms, and the
    frequencies of those in the (broadcast, sorted) vocabulary."""
    def run(batches):
        known = vocabulary.value
        find = toxicity.lookup(known)
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column(1)):
                n, doc, h = term_counts(data, offsets)
                at, term = find(h)
                code, tf = np.unique(doc[at] * np.int64(len(known)) + term, return_counts=True)
                own, term = np.divmod(code, max(len(known), 1))
                edges = pa.array(np.searchsorted(own, np.arange(last - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n),
                     pa.ListArray.from_arrays(edges, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(edges, pa.array(tf))], names=["doc_id", "n", "t", "tf"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                .mapInArrow(run, "doc_id long, n long, t array<int>, tf array<long>"))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edges = np.asarray(column.offsets).astype(np.int64)
    return edges - edges[0], column.flatten().to_numpy(zero_copy_only=False)


def impacts(vectors: DataFrame, weight, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, lead, next, t, c): impacts of the terms of each document that
    has some, and its two heaviest terms (weight times impact)."""
    def run(batches):
        w = weight.value
        for batch in batches:
            edges, t = lists(batch.column("t"))
            _, tf = lists(batch.column("tf"))
            size = np.diff(edges)
            m = 75 + 25 * batch.column("n").to_numpy() * n_docs // max(n_terms, 1)
            own = np.repeat(np.arange(len(size)), size)
            c = 1_000_000_000 * tf // (1000 * tf + 12 * m[own])
            order = np.lexsort([-(w[t] * c), own])
            some = np.flatnonzero(size)
            lead = t[order[edges[some]]]
            other = np.where(size[some] > 1, t[order[np.minimum(edges[some] + 1, max(len(t) - 1, 0))]], lead)
            offsets = pa.array(np.append(0, np.cumsum(size[some])).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some)), pa.array(lead), pa.array(other), pa.ListArray.from_arrays(offsets, pa.array(t)),
                 pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32)))], names=["doc_id", "lead", "next", "t", "c"])

    return vectors.mapInArrow(run, "doc_id long, lead int, next int, t array<int>, c array<int>")


class Items:
    """A block of items, those with the same heaviest terms together, cut into
    batches.  ``score`` is a lower bound of each item's k-th score."""

    def __init__(self, item: np.ndarray, term: np.ndarray, value: np.ndarray):
        # by item, heaviest term first
        order = np.lexsort([term, -value, item])
        item, term, value = item[order], term[order], value[order]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
        size = np.diff(np.append(first, len(item)))
        second = np.where(size > 1, term[np.minimum(first + 1, max(len(term) - 1, 0))], term[first])
        rank = np.lexsort([item[first], second, term[first]])
        take = np.concatenate([np.arange(first[r], first[r] + size[r]) for r in rank]) if len(rank) else first
        self.item, size = item[first][rank], size[rank]
        self.edges = np.append(0, np.cumsum(size))
        self.term, self.value = term[take], value[take]
        self.score = np.ones(len(self.item), np.int64)
        cuts, at = [0], 0
        while at < len(size):
            stop = int(np.searchsorted(self.edges, self.edges[at] + BATCH_TERMS, "right")) - 1
            at = min(max(stop, at + 1), at + BATCH, len(size))
            cuts.append(at)
        self.cuts = cuts


def node_max(rows: np.ndarray, size: int) -> np.ndarray:
    """Coordinate maxima of each ``size`` consecutive rows."""
    return rows.reshape(-1, size, rows.shape[1]).max(axis=1)


def padded(n: int, size: int) -> int:
    return -(-n // size) * size


class Search:
    """The best k documents of each item among those seen.  ``scored`` counts
    the (item, document) pairs that were scored exactly."""

    def __init__(self, items: Items, terms: int, k: int):
        self.items, self.k = items, k
        self.bound = items.score.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.item]
        self.root = np.zeros(terms)
        self.column = np.full(terms, -1, np.int64)
        self.batches = []
        for a, b in zip(items.cuts[:-1], items.cuts[1:]):
            lo, hi = items.edges[a], items.edges[b]
            own = np.unique(items.term[lo:hi])
            most = np.zeros(len(own))
            np.maximum.at(most, np.searchsorted(own, items.term[lo:hi]), items.value[lo:hi])
            self.batches.append((a, b, own, most))
        widest = max((len(own) for _, _, own, _ in self.batches), default=1)
        self.chunk = int(min(CHUNK, max(DOC_LEAF, CELLS // max(widest, 1) // DOC_LEAF * DOC_LEAF)))
        self.scored = 0

    def add(self, ids: np.ndarray, null: np.ndarray, edges: np.ndarray, t: np.ndarray, c: np.ndarray) -> None:
        """Search one chunk of documents (sparse rows by ``edges``)."""
        owner = np.repeat(np.arange(len(ids)), np.diff(edges))
        self.root[t] = 0
        np.maximum.at(self.root, t, c)
        for a, b, own, most in self.batches:
            bound = float(most @ self.root[own]) * UP
            # scores beyond 2**52 are not exact in doubles: integers, which are slower
            if bound >= self.bound[a:b].min():
                self.pair(a, b, own, ids, null, owner, t, c, np.float64 if bound < 2 ** 52 else np.int64)
        self.root[t] = 0

    def pair(self, a, b, own, ids, null, owner, t, c, kind) -> None:
        """One batch of items against the chunk, from nodes to leaves."""
        own = own[self.root[own] > 0]
        self.column[own] = np.arange(len(own))
        col = self.column[t]
        hit = col >= 0
        docs = np.zeros((padded(len(ids), DOC_NODE), len(own)))
        docs[owner[hit], col[hit]] = c[hit]
        lo, hi = self.items.edges[a], self.items.edges[b]
        row = np.repeat(np.arange(b - a), np.diff(self.items.edges[a: b + 1]))
        col = self.column[self.items.term[lo:hi]]
        hit = col >= 0
        items = np.zeros((padded(b - a, ITEM_NODE), len(own)))
        items[row[hit], col[hit]] = self.items.value[lo:hi][hit]
        self.column[own] = -1

        leaves, item_leaves = node_max(docs, DOC_LEAF), node_max(items, ITEM_LEAF)
        nodes, item_nodes = node_max(leaves, DOC_NODE // DOC_LEAF), node_max(item_leaves, ITEM_NODE // ITEM_LEAF)
        weakest = np.full(len(items), np.iinfo(np.int64).max)
        weakest[: b - a] = self.bound[a:b]
        by_leaf = weakest.reshape(-1, ITEM_LEAF).min(axis=1)
        by_node = weakest.reshape(-1, ITEM_NODE).min(axis=1)
        alive = item_nodes @ nodes.T * UP >= by_node[:, None]
        for i in np.flatnonzero(alive.any(axis=1)):
            below = np.repeat(alive[i], DOC_NODE // DOC_LEAF)
            first = i * (ITEM_NODE // ITEM_LEAF)
            some = np.flatnonzero(below)
            bounds = item_leaves[first: first + ITEM_NODE // ITEM_LEAF] @ leaves[some].T * UP
            stay = bounds >= by_leaf[first: first + ITEM_NODE // ITEM_LEAF, None]
            for j in np.flatnonzero(stay.any(axis=1)):
                top = (first + j) * ITEM_LEAF
                real = min(ITEM_LEAF, b - a - top)
                own_bound = self.bound[a + top: a + top + real]
                # then item by item; the most promising leaves first, so that the k-th scores rise early
                near = some[stay[j]]
                single = items[top: top + real] @ leaves[near].T * UP
                order = np.argsort(-(single - own_bound[:, None]).max(axis=0), kind="stable")
                done, step = 0, 4
                while done < len(order):
                    now = order[done: done + step]
                    now = now[(single[:, now] >= self.bound[a + top: a + top + real, None]).any(axis=0)]
                    at = (near[now][:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
                    at = at[at < len(ids)]
                    score = items[top: top + real].astype(kind) @ docs[at].T.astype(kind)
                    self.scored += score.size
                    for r in range(real):
                        self.take(a + top + r, score[r], at, ids, null)
                    done, step = done + step, step * 2

    def take(self, item: int, score: np.ndarray, at: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.bound[item]
        if not good.any():
            return
        s, d, z = self.best[item]
        at = at[good]
        s, d, z = np.append(s, score[good].astype(np.int64)), np.append(d, ids[at]), np.append(z, null[at])
        order = np.lexsort([d, z, -s])[: self.k]
        self.best[item] = s[order], d[order], z[order]
        if len(order) == self.k:
            self.bound[item] = max(self.bound[item], s[order[-1]])

    def result(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _, _ in self.best]
        column = lambda j: np.concatenate([x[j] for x in self.best]) if self.best else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.items.item, sizes)), pa.array(column(1), mask=column(2).astype(bool)), pa.array(column(0))],
            names=["item", "doc_id", "score"])


def search_chunks(vectors: DataFrame, items, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of every item (broadcast)."""
    def run(batches):
        search = Search(items.value, terms, k)
        for batch in batches:
            for first in range(0, batch.num_rows, search.chunk):
                part = batch.slice(first, search.chunk)
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                edges, t = lists(part.column("t"))
                search.add(ids.fill_null(0).to_numpy(), null, edges, t, lists(part.column("c"))[1])
        yield search.result()

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item with their rank, in two rounds."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    part = found.withColumn("part", salt)
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
    return (part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
                .where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", postings: int = POSTINGS, seed_docs: int = SEED_DOCS) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0
    for each row of ``items``, equal scores by ascending id (null last).

    Ids of documents are integers.  A null or empty text has no terms: such an
    item has no result, such a document none and no part in the statistics.
    Repeated rows are items and documents of their own; extra columns are
    ignored; empty tables give an empty result; texts are read whole.
    """
    context = docs.sparkSession.sparkContext
    asked = written(items.select(F.col(item_col).alias("asked"), F.col(item_text).alias("text"))
                         .withColumn("item", F.monotonically_increasing_id()), "search-items")
    terms = written(item_terms(asked, "text"), "search-item-terms")
    blocks = max(1, -(-terms.count() // postings))
    out = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = search_block(context, docs, own, k, id_col, text_col, seed_docs)
        out = found if out is None else out.unionByName(found)
    return (out.join(asked.select("item", "asked"), "item")
               .select(F.col("asked").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))


def search_block(context, docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str, seed_docs: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items (its terms are bounded)."""
    rows = terms.toArrow()
    item, term, times = (rows.column(c).to_numpy() for c in ("item", "term", "times"))
    known, place = np.unique(term, return_inverse=True)
    vectors = written(document_terms(docs, context.broadcast(known), id_col, text_col), "search-terms")
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = vectors.select(F.explode("t").alias("t")).groupBy("t").count().toArrow()
    df = np.zeros(len(known), np.int64)
    df[seen.column("t").to_numpy()] = seen.column("count").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    useful = (df[place] > 0) & (weight[place] > 0)
    block = Items(item[useful], place[useful], (times * weight[place])[useful])
    near = impacts(vectors, context.broadcast(weight), n_docs, n_terms)
    share = int(min(1.0, seed_docs / max(n_docs, 1)) * (1 << 20))
    seeds = near.where(F.pmod(F.xxhash64("doc_id", "t"), F.lit(1 << 20)) < share)
    first = ranked(search_chunks(seeds, context.broadcast(block), len(known), k), k).where(F.col("rank") == k).toArrow()
    at = dict(zip(first.column("item").to_pylist(), first.column("score").to_pylist()))
    block.score = np.array([max(1, at.get(i, 1)) for i in block.item.tolist()], np.int64)
    # copies share their heaviest terms; the hash spreads them over partitions
    laid = (near.withColumn("spread", F.xxhash64("doc_id", "t")).repartitionByRange("lead", "next", "spread")
                .sortWithinPartitions("lead", "next", "spread").drop("lead", "next", "spread"))
    return ranked(written(search_chunks(laid, context.broadcast(block), len(known), k), "search-found"), k)

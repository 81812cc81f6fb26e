"""Quality rules: base counts, and the hashed n-gram log-likelihood ratio of a
trusted target against the raw corpus.

Base counts find symbols, repeated lines and repeated word windows.  The
method: words, punctuation marks and pairs of neighbours are hashed to
``BUCKETS`` buckets; one multinomial is counted over the trusted documents
(label 1), one over all documents.  A document's score is the mean over its
n-grams of log(target / raw), so length does not matter.  Trusted counts are
kept by fold of a text's hash, and a document is scored without its own fold,
so neither it nor a copy of it is part of its target.  The threshold is the
cut on the score with the fewest errors over all labelled documents, found in
a histogram; each document is then kept or not by comparison alone.

Counts cover every row in one pass over the texts: each task adds its own
bucket counts, and the partial counts (bounded by ``BUCKETS``) are summed by
Spark.  No text is shuffled: rows whose id may be trusted, by a bitmap of fixed
size, leave the pass as their n-grams' buckets, two bytes each, and only these
meet the labels.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import textscan
from tabrisk.llm.spark_util import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
WINDOW = 5
#: Folds of the trusted counts; bits of the map of trusted ids (1 MB with each
#: task; beyond some million trusted ids more rows pass it, none is lost).
FOLDS, SLOTS = 5, 1 << 23
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Histogram of scores of labelled documents: bins over [-RANGE, RANGE].
BINS, RANGE = 4000, 20.0
SYMBOLS = textscan.byte_class(b"#*$%&|<>")
SPACE = ~textscan.NOT_SPACE
MARKS = textscan.PUNCT


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set entries of ``mask`` in each text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(h: np.ndarray, doc: np.ndarray, n: int, k: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a k-word window found twice or more in it."""
    grams, at = textscan.grams(h, doc, k)
    if not len(grams):
        return np.zeros(n, np.int64)
    key = grams ^ textscan.mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    edge = np.bincount(at[often], minlength=len(h) + 1) - np.bincount(at[often] + k, minlength=len(h) + 1)
    return np.bincount(doc, np.cumsum(edge)[:-1] > 0, n).astype(np.int64)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    out = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if raw.find(b"\n", a, b) >= 0:
            lines = [x for x in raw[a:b].split(b"\n") if x.strip(b"\x20\t\n\v\f\r")]
            out[i] = len(lines) - len(set(lines))
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of a slice of texts."""
    n = len(offsets) - 1
    # exact equality of words: no folding of letters
    starts, ends, h, doc = textscan.words(data, offsets, fold=np.arange(256, dtype=np.uint8))
    n_words = np.bincount(doc, minlength=n)
    chars = per_text(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
    repeat = repeated_words(h, doc, n)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": per_text(SYMBOLS[data], offsets),
            "n_dup_lines": repeated_lines(data, offsets), "n_repeat_words": repeat,
            "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)}


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all n-grams: words of letters and digits (a word of
    capitals alone has a mark of its own), runs of punctuation, and pairs."""
    starts, ends, h, doc = textscan.words(data, offsets, textscan.ALNUM)
    small = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x61) & (data <= 0x7A), out=small[1:])
    big = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=big[1:])
    shouted = (small[ends] == small[starts]) & (big[ends] - big[starts] >= 2)
    s2, e2, h2, d2 = textscan.words(data, offsets, MARKS)
    order = np.argsort(np.concatenate([starts, s2]), kind="stable")
    h = np.concatenate([np.where(shouted, ~h, h), h2])[order]
    doc = np.concatenate([doc, d2])[order]
    pairs, at = textscan.grams(h, doc, 2)
    both = np.concatenate([h, pairs]) >> np.uint64(48)
    return both.astype(np.int64), np.concatenate([doc, doc[at]])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fold, text): equal texts have one fold."""
    fold = F.pmod(F.xxhash64(F.col(text_col), F.lit("fold")), F.lit(FOLDS)).cast("int")
    return docs.select(F.col(id_col).alias("id"), fold.alias("fold"), F.col(text_col).alias("text"))


def slot_map(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``SLOTS`` hashes, as bytes, with the slots of all ``ids`` set
    (at most SLOTS / 64 words reach the driver)."""
    words = (ids.select(slot("id").alias("slot")).groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).toArrow())
    out = np.zeros(SLOTS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def slot(c: str):
    return F.pmod(F.xxhash64(c), F.lit(SLOTS))


def counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts over all rows of ``docs``: of trusted rows [fold, bucket]
    and of all rows [bucket].  A row is trusted if ``labels`` has its id with
    label 1."""
    kind = docs.schema[id_col].dataType.simpleString()
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast(kind).alias("id")).where("id is not null").distinct()
    bits = slot_map(trusted)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        kind_of_id = None
        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            at = batch.column(2).to_numpy()
            maybe = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            maybe &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, last, data, offsets in textscan.slices(batch.column(3)):
                bucket, doc = buckets(data, offsets)
                total += np.bincount(bucket, minlength=BUCKETS)
                rows = np.flatnonzero(maybe[first:last])
                if not len(rows):
                    continue
                mine = np.flatnonzero(maybe[first:last][doc])
                mine = mine[np.argsort(doc[mine], kind="stable")]
                ends = np.cumsum(np.bincount(doc[mine], minlength=last - first))[rows]
                small = bucket[mine].astype(np.uint16)
                grams = pa.array([small[i:j].tobytes() for i, j in zip(np.append(0, ends[:-1]), ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + first)), batch.column(1).take(pa.array(rows + first)),
                                                  grams, pa.nulls(len(rows), pa.int64())], names=names)
        if kind_of_id is not None:
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(found), kind_of_id), pa.array(found.astype(np.int32)),
                                              pa.nulls(len(found), pa.binary()), pa.array(total[found])], names=names)

    def add(batches):
        total = np.zeros(FOLDS * BUCKETS, np.int64)
        for batch in batches:
            for fold, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = total[fold * BUCKETS: (fold + 1) * BUCKETS]
                own += np.bincount(np.frombuffer(grams.as_buffer(), np.uint16), minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["place", "n"])

    names = ["id", "place", "grams", "n"]
    texts = keyed(docs, id_col, text_col).select("id", "fold", slot("id").alias("slot"), "text")
    parts = written(texts.mapInArrow(run, f"id {kind}, place int, grams binary, n long"), "gram-counts")
    # one plan at every size: the trusted ids grow with the labels and are not broadcast
    mine = parts.where("id is not null").join(trusted.hint("merge"), "id", "left_semi").select("place", "grams").mapInArrow(add, "place int, n long")
    out = []
    for size, part in ((FOLDS * BUCKETS, mine), (BUCKETS, parts.where("grams is null").select("place", "n"))):
        got = part.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(size, np.int64)
        sums[got.column("place").to_numpy()] = got.column("n").to_numpy()
        out.append(sums)
    return out[0].reshape(FOLDS, BUCKETS), out[1]


def log_ratio(n: np.ndarray, prior: float = 1.0) -> np.ndarray:
    """log(target / raw) by bucket, both smoothed by the raw distribution so
    that a bucket without evidence has ratio one."""
    target, raw = n.astype(float)
    share = (raw + 1e-9) / max(raw.sum(), 1.0)
    weight = prior * BUCKETS
    return np.log((target + weight * share) / (target.sum() + weight)) - np.log(share) if target.sum() else np.zeros(BUCKETS)


def fold_ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) [fold, bucket], with the target counted without the fold."""
    return np.stack([log_ratio(np.stack([trusted.sum(axis=0) - own, raw])) for own in trusted])


def scores(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base columns, score) of every row; no shuffle.  The table of ratios
    (FOLDS * BUCKETS numbers) travels with the task."""
    ratio = ratio.astype(np.float32)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fold = batch.column(1).to_numpy()
            for first, last, data, offsets in textscan.slices(batch.column(2)):
                n = last - first
                base = base_counts(data, offsets)
                bucket, doc = buckets(data, offsets)
                grams = np.bincount(doc, minlength=n)
                mean = np.bincount(doc, ratio[fold[first:last][doc], bucket].astype(float), n) / np.maximum(grams, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *map(pa.array, base.values()),
                                                  pa.array(np.round(mean, 9))], names=["id", *base, "score"])

    return (keyed(docs, id_col, text_col)
                .mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, score double"))


def threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
              cost_of_losing: float = 2.0) -> float:
    """The cut with the fewest errors over all labelled rows that pass the base
    rules (a good row lost counts ``cost_of_losing``), from a histogram of
    BINS scores; 0 if one label has no row."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    place = F.floor((F.greatest(F.least("score", F.lit(RANGE)), F.lit(-RANGE)) + RANGE) / (2 * RANGE) * BINS)
    rows = (scored.where(~F.col("base_failed")).select("id", place.cast("int").alias("bin")).join(lab, "id")
                  .groupBy("bin", "y").count().collect())  # at most 2 * (BINS + 1) rows
    n = np.zeros((2, BINS + 2))
    for r in rows:
        n[r["y"], r["bin"]] = r["count"]
    if not n.sum(axis=1).all():
        return 0.0
    # rejecting the bins below the cut loses good rows there and keeps bad rows above
    lost = np.concatenate([[0], np.cumsum(n[1])])
    passed = n[0].sum() - np.concatenate([[0], np.cumsum(n[0])])
    cost = cost_of_losing * lost + passed
    best = np.flatnonzero(cost == cost.min())
    cut = best[len(best) // 2]  # the middle of the widest equal stretch around the minimum
    return float(cut / BINS * 2 * RANGE - RANGE)


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: id, base columns, score, kept.

    kept is false if the base rules fail, else whether the score reaches the
    threshold.  A null or empty text has no words and fails the base rules.
    Without trusted documents all scores are 0 and the base rules decide.
    Repeated rows each get a row, and equal texts one score; rows with a null
    id are scored and never labelled; a very long text is read whole; extra
    columns are ignored; an empty table gives no row.
    """
    ratio = fold_ratios(*counts(docs, labels, id_col, text_col, label_col))
    scored = written(scores(docs, ratio, id_col, text_col), "scores")
    cut = threshold(scored, labels, id_col, label_col)
    return (scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))
                  .withColumnRenamed("id", id_col))

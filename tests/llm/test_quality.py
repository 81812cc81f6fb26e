import random
import re
from collections import Counter

import pytest

from tabrisk.llm import cotraining, quality_rules

DOCS = "doc_id long, text string, lang string, source string, kept string, id int"
LABELS = "doc_id long, quality int, toxic int"
GOOD = "the river of an old town was then in for with and on plain meadow light morning".split()


def prose(rng, n):
    return " ".join(rng.choice(GOOD) + rng.choice(["", "", ",", "."]) + rng.choice(["", "er", "ing"]) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.choice([20, 80, 300]))
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "%%% "),
                               lambda t: t.replace(" ", " | ")])(text)
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", None]), "clash", 1))
        if i % 3:
            labels.append((i, int(good), 0))
    truth = {r[0]: (not re.search(r"!!|%%%|\|", r[1])) for r in rows}
    rows += [(1000, None, None, None, "", 0), (1001, "", "en", "a", "", 0), (1002, " \n\t", "en", "a", "", 0), (0, rows[0][1], "en", "a", "", 0),
             (None, prose(rng, 50), "en", "a", "", 0), (1003, "x" * 60000 + " " + prose(rng, 3000), "en", "a", "", 0)]
    return rows, labels + [(None, 1, 1), (5000, 0, 0), (3, None, None)], truth


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_base_counts_match_brute_force():
    import numpy as np
    import pyarrow as pa
    from tabrisk.llm import textscan
    rng = random.Random(2)
    texts = ["", None, "a b\n a b\n\n \na b", "é ü# <b> x", "A a A a"] + [
        "".join(rng.choice(["a", "B", "b", " ", "\n", "\t", "é", "#", " a b c d e "]) for _ in range(rng.randrange(120))) for _ in range(200)]
    got = []
    for _, _, data, offsets in textscan.slices(pa.array(texts), 300):
        base = quality_rules.base_counts(data, offsets)
        got += list(zip(*[np.asarray(v).tolist() for v in base.values()]))
    assert got == [brute(t) for t in texts]


def test_rate(spark):
    rows, labels, truth = corpus()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality_rules.rate(docs, lab).collect()
    assert len(got) == len(rows)
    text = {}
    for r in rows:
        text.setdefault(r[0], r[1])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in got:
        assert tuple(r[c] for c in names) == brute(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    right = [r["kept"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and not r["base_failed"]]
    assert sum(right) >= 0.97 * len(right)


@pytest.mark.parametrize("slots", [quality_rules.SLOTS, 64])
def test_rate_counts_against_brute_force(spark, monkeypatch, slots):
    """The bucket counts of the job are those of a plain loop over all texts, with a full map of ids too."""
    import numpy as np
    import pyarrow as pa
    from tabrisk.llm import textscan
    monkeypatch.setattr(quality_rules, "SLOTS", slots)
    rows, labels, _ = corpus(60)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    docs = spark.createDataFrame(rows, DOCS)
    fold = {(r["id"], r["text"]): r["fold"] for r in quality_rules.keyed(docs, "doc_id", "text").collect()}
    trusted, raw = np.zeros((quality_rules.FOLDS, quality_rules.BUCKETS), int), np.zeros(quality_rules.BUCKETS, int)
    for i, text, *_ in rows:
        for _, _, data, offsets in textscan.slices(pa.array([text])):
            one = np.bincount(quality_rules.buckets(data, offsets)[0], minlength=quality_rules.BUCKETS)
            raw += one
            if i in good:
                trusted[fold[i, text]] += one
    got = quality_rules.counts(docs, spark.createDataFrame(labels, LABELS))
    assert (got[0] == trusted).all() and (got[1] == raw).all() and len(set(fold.values())) == quality_rules.FOLDS


def test_a_row_is_not_its_own_target(spark):
    """Words that only one trusted text and its copies hold get no credit in their own scores."""
    rows, labels, _ = corpus(60)
    rare = " ".join(f"unseen{k} strange{k}" for k in range(40))
    rows += [(2000, rare, None, None, "", 0), (2001, rare, None, None, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)

    def score(labels):
        ratio = quality_rules.fold_ratios(*quality_rules.counts(docs, spark.createDataFrame(labels, LABELS)))
        return {r["id"]: r["score"] for r in quality_rules.scores(docs, ratio).collect()}
    without, with_own = score(labels), score(labels + [(2000, 1, 0)])
    assert with_own[2000] == with_own[2001] == without[2000]


def test_no_labels_and_no_rows(spark):
    rows, _, _ = corpus(20)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules.rate(docs, none).collect())
    assert quality_rules.rate(docs.limit(0), none).collect() == []
    model = cotraining.fit(docs, none)
    assert len(cotraining.score(docs, model).collect()) == len(rows)
    assert cotraining.score(docs.limit(0), cotraining.fit(docs.limit(0), none)).collect() == []


def test_cotraining_held_out(spark):
    rows, labels, truth = corpus(400)
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = cotraining.score(docs, cotraining.fit(docs, lab)).collect()
    assert len(got) == len(rows)
    seen = {i for i, *_ in labels}
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] not in seen]
    assert len(held) > 100 and sum(r["kept"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert not any(r["kept"] for r in got if r["doc_id"] in (1000, 1001, 1002))
    again = cotraining.score(docs, cotraining.fit(docs, lab)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert all(0 <= r[c] <= 1 for r in got for c in ("p_text", "p_meta", "p"))


def test_every_unlabelled_row_takes_part(spark):
    """Histograms and pseudo-labels count all rows without a label, foreign labels or not."""
    import numpy as np
    rows, labels, _ = corpus(300)
    labels += [(10_000 + i, 1, 0) for i in range(300)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    context = spark.sparkContext
    got = cotraining.labelled_rows(docs, lab, "doc_id", "text", "quality", 5000)
    known = [np.unique(got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)) for c in ("t", "m")]
    pool = cotraining.unlabelled_rows(docs, lab, [context.broadcast(k) for k in known], "doc_id", "text", "quality")
    with_label = {i for i, q, _ in labels if q is not None and i is not None}
    free = [r for r in rows if r[0] not in with_label]
    assert pool.count() == len(free)
    scales = [(np.zeros(n), np.ones(n)) for n in (cotraining.TEXT_DENSE, cotraining.META_DENSE)]
    rng = np.random.default_rng(1)
    weights = [rng.normal(0, 0.3, len(k) + len(m) + 1) for k, (m, _) in zip(known, scales)]
    sent = context.broadcast(weights)
    counts = cotraining.confidences(pool, sent, scales)
    assert (counts.sum(axis=(1, 2)) == 2 * len(free)).all()
    cuts = np.array([[0.6, 0.55], [0.5, 0.7]])
    taken = cotraining.adapted(pool, sent, scales, cuts)
    # the same rows by hand
    table = pool.toArrow().combine_chunks().to_batches()[0]
    views = cotraining.view_columns(table, scales)
    for giver, taker in ((0, 1), (1, 0)):
        p = 1 / (1 + np.exp(-views[giver].margin(weights[giver])))
        sure = np.where(p >= 0.5, p >= cuts[giver][1], 1 - p >= cuts[giver][0])
        assert taken[taker][0] == sure.sum()
        # both classes pull the taking view towards their labels
        before, after = views[taker].margin(weights[taker])[sure], views[taker].margin(taken[taker][1])[sure]
        y = (p >= 0.5)[sure]
        loss = lambda z: np.log1p(np.exp(-np.where(y, z, -z))).mean()
        assert loss(after) < loss(before)


def test_labelled_rows_are_bounded(spark):
    rows = [(7, f"text number {i % 900} of many", "en", "a", "", 0) for i in range(3000)] + [(i, f"other {i}", "en", "a", "", 0) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, DOCS)
    repeated = spark.createDataFrame([(7, 1, 0)], LABELS)
    assert 0 < cotraining.labelled_rows(docs, repeated, "doc_id", "text", "quality", 100).num_rows <= 200
    foreign = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 3400)], LABELS)
    assert cotraining.labelled_rows(docs, foreign, "doc_id", "text", "quality", 1000).num_rows == 300
    model = cotraining.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(0, 3400)], LABELS), max_rows=200)
    assert len(model.views) == 2 and 0 <= model.threshold <= 1


def test_cut_takes_whole_bins():
    import numpy as np
    counts = np.zeros(cotraining.BINS, int)
    counts[-1], counts[-2], counts[-50] = 5, 4, 100
    step = 1 / cotraining.BINS
    assert cotraining.cut_of(counts, 9) == pytest.approx(1 - 49 * step) and cotraining.cut_of(counts, 7) == pytest.approx(1 - step)
    assert cotraining.cut_of(counts, 200) == cotraining.SURE
    # rows of equal confidence go together, though they are more than asked for
    assert cotraining.cut_of(counts, 2) == pytest.approx(1 - step)
    assert cotraining.cut_of(np.zeros(cotraining.BINS, int), 5) >= cotraining.SURE


def test_views_learn_from_each_other():
    """Rows that only one view can tell teach the other's weights."""
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    view = cotraining.View(np.arange(401), np.where(rng.random(400) < 0.9, y, 1 - y).astype(int), np.zeros((400, 0)))
    w = cotraining.descend(view, y, np.zeros(3), cotraining.PULL, cotraining.STEPS)
    assert ((view.margin(w) > 0) == y).mean() > 0.85


@pytest.mark.parametrize("quality", [0, 1])
def test_one_class_only(spark, quality):
    rows, labels, _ = corpus(40)
    docs = spark.createDataFrame(rows, DOCS)
    model = cotraining.fit(docs, spark.createDataFrame([(i, quality, 0) for i, *_ in labels if i is not None], LABELS))
    assert model.threshold == 0.5 and len(cotraining.score(docs, model).collect()) == len(rows)

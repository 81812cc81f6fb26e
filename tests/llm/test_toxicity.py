import random

from tabrisk.llm import toxicity

DOCS = "doc_id long, text string, rejected string, y int"
LABELS = "doc_id long, quality int, toxic int"
PLAIN = "the a river was in morning light town and with of some plain slow road".split()


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(["", "er", "s", "ing"]) for _ in range(rng.choice([15, 60, 200]))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 5) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["Blorg", "zarknut", "snivel" + rng.choice(["er", "est", "ation", "ly", "ous"])])
        rows.append((i, " ".join(words) + ".", "clash", 3))
        truth[i] = bad
        if i % 2:
            labels.append((i, 1, int(bad)))
    rows += [(900, None, "", 0), (901, "", "", 0), (902, " \n", "", 0), (1, rows[1][1], "", 0), (None, rows[0][1], "", 0),
             (903, "town " * 50000, "", 0)]
    return rows, labels + [(None, 0, 1), (5, None, None), (7777, 1, 1)], truth


def test_held_out_rows(spark):
    rows, labels, truth = corpus()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    chain = toxicity.fit(docs, lab)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] % 2 == 0]
    assert sum(r["rejected"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert not any(r["rejected"] for r in got if r["doc_id"] in (900, 901, 902, 903))
    assert all(0 <= r[f"p_{c}"] <= 1 for r in got for c in toxicity.CATEGORIES)
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns
    rejected = sorted(str(r["doc_id"]) for r in got if r["rejected"])
    assert sorted([str(r[0]) for r in rows]) == sorted([str(r[0]) for r in kept.collect()] + rejected)
    # the same sample gives the same chain
    assert sorted(toxicity.score(docs, toxicity.fit(docs, lab)).collect(), key=str) == sorted(got, key=str)


def test_labelled_rows_are_bounded(spark, monkeypatch):
    import numpy as np
    rows = [(7, f"town {i % 900} road", "", 0) for i in range(3000)] + [(i, f"river {i}", "", 0) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, DOCS)
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda r, *a, **k: seen.append(len(r)) or train(r, *a, **k))
    toxicity.fit(docs, spark.createDataFrame([(7, 1, 1)], LABELS), max_rows=100)
    toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(100, 3400)], LABELS), max_rows=1000)
    assert 0 < seen[0] <= 200 and seen[1] == 300


def test_markers_come_from_other_rows():
    """A row's category never rests on a marker that only this row makes one."""
    import numpy as np
    from tabrisk.llm import linear
    rows = linear.Rows.of([[1, 2], [1, 2], [1, 2], [1, 3], [3, 4]])
    toxic = np.array([1, 1, 1, 1, 0])
    assert toxicity.weak_categories(rows, toxic, np.full(5, 5), np.ones(5, bool))[:, 0].tolist() == [1, 1, 1, 1, 0]
    without = toxicity.weak_categories(rows, toxic, np.full(5, 5), np.array([1, 1, 0, 0, 1], bool))
    assert without[:, 0].tolist() == [0, 0, 0, 0, 0]


def test_later_models_use_earlier_categories():
    import numpy as np
    from tabrisk.llm import linear
    rng = np.random.default_rng(0)
    toxic = rng.integers(0, 2, 200)
    rows = linear.Rows.of([[int(t) * 7 + 1, int(rng.integers(50, 90))] for t in toxic])
    chain = toxicity.train(rows, toxic, np.full(200, 10))
    assert [len(m.dense) for m in chain.models] == [0, 1, 2, 3]
    assert any(abs(m.dense).max() > 0 for m in chain.models[1:])


def test_score_is_the_sum_of_present_weights():
    """The scorer against a plain sum over each text's distinct features."""
    import numpy as np
    import pyarrow as pa
    from tabrisk.llm import linear, textscan
    texts = ["Blorg town Blorg", "plain", None, "snivelation of zark"]
    (_, _, data, offsets), = textscan.slices(pa.array(texts))
    kinds, doc = toxicity.word_features(data, offsets)
    lists = toxicity.present(kinds, doc, len(texts))
    known = np.unique(np.concatenate(lists))
    rng = np.random.default_rng(1)
    models = [linear.Linear(0.1 * j, known, rng.standard_normal(len(known)), rng.standard_normal(j)) for j in range(4)]
    p, _ = toxicity.scorer(toxicity.Chain(models, 0.5))(pa.array(texts))
    for i, own in enumerate(lists):
        before = []
        for j, m in enumerate(models):
            z = m.bias + sum(m.weights[np.searchsorted(known, x)] for x in own) + sum(a * b for a, b in zip(before, m.dense))
            before.append(1 / (1 + np.exp(-z)))
        assert np.allclose(p[i], before)


def test_no_labels_and_no_rows(spark):
    rows, _, _ = corpus(20)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    chain = toxicity.fit(docs, none)
    assert not any(r["rejected"] for r in toxicity.score(docs, chain).collect())
    empty = docs.limit(0)
    assert toxicity.score(empty, chain).collect() == [] and toxicity.keep_clean(empty, chain).collect() == []

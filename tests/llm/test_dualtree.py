import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabrisk.llm import dualtree

DOCS = "doc_id long, text string, item long, score long, n long"
ITEMS = "item_id long, text string, asked long, doc_id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or ""))


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        q, found = terms(text), []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 12 * m))
                    for t, c in q.items() if t in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    word = lambda: "w" + str(int(60 * rng.random() ** 2))
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + j, docs[5][1]) for j in range(60)] + [(5, docs[5][1]), (7, "W1 É é x"), (None, docs[5][1]), (None, "w1 w2"), (9999, None), (9998, " ,. ")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(30)]
    items += [(3, "w1 w1 w1"), (50, None), (51, "nothing"), (52, docs[5][1]), (None, "É w2"), (53, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("postings, seeds", [(4_000_000, 20_000), (60, 40)])
def test_equals_brute_force(spark, postings, seeds):
    docs, items = corpus()
    got = dualtree.search(spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 4, 5) for i, t in items], ITEMS),
                          k=20, postings=postings, seed_docs=seeds)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 20)


def random_search(scale, n_docs=6000, n_items=100, n_terms=400, seed=1, k=5):
    """Documents and items that come in kinds with terms of their own."""
    rng = np.random.default_rng(seed)
    def rows(n, most):
        out = []
        for kind in np.arange(n) % 20 if n < 1000 else np.sort(np.arange(n) % 20):
            out.append(np.unique(np.concatenate([rng.integers(kind * 20, kind * 20 + 20, most), rng.integers(0, n_terms, 2)])))
        return out
    docs, asked = rows(n_docs, 8), rows(n_items, 6)
    edges = np.append(0, np.cumsum([len(r) for r in docs]))
    t, c = np.concatenate(docs), rng.integers(1, 1000, edges[-1])
    block = dualtree.Items(np.repeat(np.arange(n_items), [len(r) for r in asked]), np.concatenate(asked),
                           rng.integers(1, 9000, sum(map(len, asked))) * scale)
    found = dualtree.Search(block, n_terms, k)
    ids = rng.permutation(n_docs)
    for a in range(0, n_docs, found.chunk):
        b = min(a + found.chunk, n_docs)
        found.add(ids[a:b], np.zeros(b - a, bool), edges[a: b + 1] - edges[a], t[edges[a]: edges[b]], c[edges[a]: edges[b]])
    dense, q = np.zeros((n_docs, n_terms), object), np.zeros((n_items, n_terms), object)
    dense[np.repeat(np.arange(n_docs), np.diff(edges)), t] = c.tolist()
    q[np.repeat(block.item, np.diff(block.edges)), block.term] = block.value.tolist()
    want = []
    for i in range(n_items):
        s = dense @ q[i]
        want += [(i, int(ids[j]), int(s[j])) for j in sorted(range(n_docs), key=lambda j: (-s[j], ids[j]))[:k] if s[j] > 0]
    got = found.result()
    return sorted(zip(*[got.column(j).to_pylist() for j in range(3)])), sorted(want), found.scored / (n_docs * n_items)


@pytest.mark.parametrize("scale", [1, 10 ** 11])
def test_bounds_prune_and_lose_nothing(scale):
    """Scores beyond 2**53 take the integer way; most pairs are never scored."""
    got, want, share = random_search(scale)
    assert got == want and share < 0.5


def test_k_th_score_ties_stay():
    block = dualtree.Items(np.array([7]), np.array([0]), np.array([3]))
    found = dualtree.Search(block, 1, 2)
    for ids in ([9, 8, 7], [1, 2, 3]):
        found.add(np.array(ids), np.zeros(3, bool), np.arange(4), np.zeros(3, np.int64), np.full(3, 5))
    assert found.result().column(1).to_pylist() == [1, 2]


def test_long_text_and_wide_items(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    docs = [(1, long), (2, "t5 t6"), (3, "t5"), (4, "z")]
    items = [(1, long), (2, "t5 t6 q")]
    got = dualtree.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 20)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", 1, 1, 1), (2, "c", 1, 1, 1)], DOCS)
    ask = spark.createDataFrame([(1, "a", 1, 1)], ITEMS)
    assert dualtree.search(docs, ask).collect() == [] and dualtree.search(some, items).collect() == []
    assert [tuple(r)[:3] for r in dualtree.search(some, ask).collect()] == [(1, 1, 1)]

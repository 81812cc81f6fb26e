import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabrisk.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, wid long"


def words_of(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def brute(rows):
    n = words_of(rows)
    same, longer = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            same[i, w[:i] + w[i + 1:]].add(w)
            longer[w[:i] + w[i + 1:]].add(w)
    form, near = {}, {}
    for w in n:
        found = set(longer.get(w, ()))
        for i in range(len(w)):
            rest = w[:i] + w[i + 1:]
            found |= same[i, rest] | ({rest} if rest in n else set())
        near[w] = found - {w}
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10 ** 6))
def test_composition_finds_every_pair(m, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(rng.randint(1, 5)):
        rows += [(g, x) for x in sorted({"".join(rng.choice("abc") for _ in range(rng.choice([m, m + 1]))) for _ in range(rng.randint(1, 12))})]
    size, group = np.array([len(x) for _, x in rows]), np.array([g for g, _ in rows])
    text = np.zeros((len(rows), size.max()), np.uint8)
    for i, (_, x) in enumerate(rows):
        text[i, : len(x)] = list(x.encode())
    x, y = spelling.near_pairs(text, size, group, np.full(group.max() + 1, m), np.full(group.max() + 1, True))
    want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
            if group[i] == group[j] and min(size[i], size[j]) == m and one_edit(rows[i][1], rows[j][1])]
    assert sorted((min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())) == want


def test_acceptor_is_minimal():
    words = sorted(["tap", "taps", "top", "tops"])
    size = np.array([len(w) for w in words])
    text = np.zeros((4, 4), np.uint8)
    for i, w in enumerate(words):
        text[i, : len(w)] = list(w.encode())
    machine = spelling.Acceptor(text, size, np.zeros(4, np.int64))
    assert len(machine.final) == 5  # start, t, ta = to, tap = top, taps = tops
    assert machine.strings[machine.initial].tolist() == [4]


def test_crcs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000, np.uint8)
    size = rng.integers(0, 100, 60)
    starts = rng.integers(0, 3900, 60)
    before = rng.integers(0, 1 << 32, 60, np.uint32)
    want = [zlib.crc32(data[s: s + n].tobytes(), int(b)) for s, n, b in zip(starts, size, before)]
    assert spelling.crcs(data, starts, size, before).tolist() == want


def texts():
    rng = random.Random(5)
    stock = ["".join(rng.choice("abÀ") for _ in range(rng.randint(4, 7))) for _ in range(400)]
    rows = [(i, " ".join(stock[int(400 * rng.random() ** 3)] for _ in range(120))) for i in range(80)]
    long = "ab" * 300
    odd = [(None, "Straße straße straße œuvre œuvre œuvre ×÷×÷× ×÷×÷× ×÷×÷×"), (5, None), (6, ""), (7, "hello hello hello hellp hellp hellp"),
           (7, "hello hello hello"), (9, f"{long} {long} {long} {long}c {long}c {long}c"), (10, " ".join([long[:250] + "x" + long[250:]] * 7))]
    return rows + odd


@pytest.mark.parametrize("region, limit", [(32, 50_000), (3, 6)])
def test_variants(spark, region, limit):
    rows = texts()
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in spelling.variants(df, region=region, limit=limit).collect())
    want = brute(rows)
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, "", 0, 0)], SCHEMA)).collect() == []

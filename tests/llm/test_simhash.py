import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from tabrisk.llm import pairing, simhash

SCHEMA = "doc_id long, text string, fp string, component_id long"


def brute_print(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limit=4):
    """[(id, fp)] -> smallest reachable id by id position."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= limit:
                root[find(i)] = find(j)
    out = []
    for i in range(len(prints)):
        ids = [prints[j][0] for j in range(len(prints)) if find(j) == find(i) and prints[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def check(rows, df):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_components(prints))), key=str)
    assert got == want


def make_texts(rng, n):
    vocab = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 30, 120, 400]))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    return out


def test_fingerprint_matches_brute_force():
    for t in ["", "one", "Two words", "a b c d", "Ä b\tc\nd e  f", "x " * 300]:
        assert simhash.fingerprint(t.encode()) == brute_print(t)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**9))
def test_index_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fp = rng.choice(centres, 700)
    for _ in range(4):
        fp ^= np.where(rng.random(700) < 0.6, np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64), np.uint64(0))
    owner = np.sort(rng.integers(0, 4, 700))
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fp = fp[np.lexsort([rank, owner])]
    want = (np.bitwise_count(fp[:, None] ^ fp) <= 4) & (owner[:, None] == owner)
    want = set(zip(*np.nonzero(np.triu(want, 1))))
    got = [(i, j) for a, b in simhash.linked_pairs(fp, owner, 4, 1000) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


def test_stars_keep_components():
    a, b = pairing.stars(np.array([5, 4, 9, 7, 2, 9]), np.array([4, 3, 7, 9, 2, 8]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(4, 3), (5, 3), (8, 7), (9, 7)]


def test_masks_cover_every_four_bits():
    masks = simhash.block_masks(4)
    rng = random.Random(0)
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not apart & m for m in masks)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts = make_texts(rng, 120) + [None, "", " \n", "x", "x"]
    rows = [(i * 3 + 1, t, "clash", 0) for i, t in enumerate(texts)] + [(None, texts[0], "clash", 0), (4, texts[1], "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, simhash.near_duplicates(df))


def test_split_cells_give_the_same(spark):
    rng = random.Random(8)
    rows = [(i, t, "", 0) for i, t in enumerate(make_texts(rng, 80))]
    prints = simhash.fingerprints(spark.createDataFrame(rows, SCHEMA))
    nodes = prints.select("fp").distinct()
    from tabrisk.llm.spark_util import components
    whole = components(simhash.links(nodes)).collect()
    split = components(simhash.links(nodes, cell_rows=2)).collect()
    assert sorted(whole) == sorted(split)


def test_keep_one(spark):
    rows = [(5, "a b c d e", "", 0), (3, "a b c d e", "", 0), (3, "a b c d e", "", 0), (9, "z y x w v", "", 0), (None, "q", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r[0] or -1) for r in got.collect()) == [-1, 3, 9]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    x, y, z = "a b c d e", "other words of a text that is not like it", "third text without any id in its rows"
    rows = [(3, x, "", 0), (5, x, "", 0), (5, y, "", 0), (7, z + " 1 2 3", "", 0), (7, "q r s t u v w", "", 0),
            *[(None, z, "", 0)] * 20, (None, z, "b", 0), (None, x, "", 0), (9, "k l m n", "b", 1), (9, "k l m n", "a", 2), (9, "k l m n", "a", 2)]
    found = []
    for parts in (1, 3, 7):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, SCHEMA).repartition(parts)
            found.append(sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=str))
    assert all(f == found[0] for f in found)
    components = {r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert components == {3, 5, 7, 9, None}
    texts = sorted((str(r[0]), r[1]) for r in found[0])
    assert texts == sorted([("3", x), ("5", y), ("7", z + " 1 2 3"), ("7", "q r s t u v w"), ("9", "k l m n"), ("None", z)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == [] and simhash.keep_one(df).collect() == []

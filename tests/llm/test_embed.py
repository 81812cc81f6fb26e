import math
import random

import numpy as np

from tabrisk.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cls string"


def brute(rows, limit=E.COSINE):
    """{row number: (n_links, component)} by all pairs."""
    ok = {}
    for i, (_, v, label, *_) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            ok[i] = v / np.linalg.norm(v)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * len(rows)
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= limit - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids.setdefault(find(i), []).append(r[0])
    return [(r[0], links[i], min(ids[find(i)]) if find(i) in ids else None) for i, r in enumerate(rows)]


def make(seed=9, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(64)
        if i % 3 and rows:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            v = base / np.linalg.norm(base) + 0.03 * rng.standard_normal(64) * rng.choice([0, 0.3, 1])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(3)), 1, "clash"))
    return rows


def test_lattice():
    steps = E.minimal_vectors()
    assert len(np.unique(steps, axis=0)) == 240 and np.allclose((steps ** 2).sum(axis=1), 2)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8)) * 3
    p = E.decode(x)
    doubled = np.rint(2 * p).astype(int)
    assert np.allclose(2 * p, doubled) and (p.sum(axis=1) % 2 == 0).all()
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all()
    own = ((x - p) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius of E8
    assert all((own <= ((x - p - s) ** 2).sum(axis=1) + 1e-9).all() for s in steps)


def test_recall_against_brute_force():
    """Pairs at and above the limit meet in a cell; for one and for two groups of eight."""
    rng = np.random.default_rng(1)
    n = 1500
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    for blocks in (1, 2):
        for cosine in (0.93, 0.97):
            r = rng.standard_normal((n, 64))
            r -= (r * a).sum(axis=1, keepdims=True) * a
            r /= np.linalg.norm(r, axis=1, keepdims=True)
            b = cosine * a + math.sqrt(1 - cosine ** 2) * r
            (ha, pa), (hb, pb) = (E.cell_keys(x, 1, E.TABLES, blocks, E.PROBES, E.SCALE, E.SEED) for x in (a, b))
            met = (ha == hb) | (pa == hb[:, :, None]).any(axis=2) | (pb == ha[:, :, None]).any(axis=2)
            assert met.any(axis=1).mean() >= (0.99 if blocks == 1 else 0.95)


def planted(rng, n, cosine):
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((n, 64))
    r -= (r * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + math.sqrt(1 - cosine ** 2) * r / np.linalg.norm(r, axis=1, keepdims=True)


def test_recall_does_not_fall_with_groups():
    a, b = planted(np.random.default_rng(3), 1500, 0.93)
    for blocks in (1, 2, 3):
        (ha, pa), (hb, pb) = (E.cell_keys(x, 1, E.tables_for(blocks), blocks, E.PROBES, E.SCALE, E.SEED) for x in (a, b))
        met = (ha == hb) | (pa == hb[:, :, None]).any(axis=2) | (pb == ha[:, :, None]).any(axis=2)
        assert met.any(axis=1).mean() >= 0.99, blocks


def test_large_label_does_not_coarsen_the_others(spark, monkeypatch):
    """A label of three groups and one of a single group: pairs of both are found."""
    monkeypatch.setattr(E, "SPREAD", 16)
    rng = np.random.default_rng(4)
    rows = []
    for label, n in ((1, 300), (2, 15)):
        a, b = planted(rng, n, 0.935)
        for k in range(n):
            rows += [(len(rows) + j, [float(x) for x in v[k]], label, 0, "") for j, v in enumerate((a, b))]
    got = {r["vec_id"]: r["component_id"] for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = [got[i] == got[i + 1] for i in range(0, len(rows), 2)]
    assert sum(found[:300]) >= 0.99 * 300 and all(found[300:])


def test_links_and_components(spark):
    rows = make()
    rows += [(500, None, 1, 0, ""), (501, [0.0] * 64, 1, 0, ""), (502, [float("nan")] * 64, 1, 0, ""), (503, [None] * 64, 1, 0, ""), (504, [], 1, 0, ""),
             (505, rows[0][1], None, 0, ""), (506, rows[0][1][:32], rows[0][2], 0, ""), (None, rows[0][1], rows[0][2], 0, ""), (0, *rows[0][1:]),
             (507, [float("inf")] + [0.0] * 63, 1, 0, ""), (508, [1e-30] * 64, 2, 0, ""), (509, [1e30] * 64, 2, 0, "")]
    rows += [(600 + i, rows[5][1], rows[5][2], 0, "") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    split = E.near_duplicates(df, cell_rows=2).collect()  # every cell in pair cells
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in split), key=str) == got
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in split)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(64)
    rows = [(i, [float(x) for x in np.float32(base + 0.001 * rng.standard_normal(64))], 1, 0, "") for i in range(1500)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), cell_rows=300).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1499, 0)}


def test_doubles_and_empty_table(spark):
    rows = []
    for i in range(20):
        rng = random.Random(i // 2)
        rows.append((i, [rng.gauss(0, 1) for _ in range(16)], 7))
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert sorted((r["vec_id"], r["component_id"]) for r in got) == [(i, i // 2 * 2) for i in range(20)]
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketches_keep_pairs_at_the_limit():
    a, b = planted(np.random.default_rng(5), 5000, E.COSINE)
    words = [E.sketches(E.unit_rows(x, len(x)), E.SEED) for x in (a, b)]
    differ = np.bitwise_count(words[0] ^ words[1]).sum(axis=1)
    assert (differ <= E.sketch_limit(E.COSINE)).mean() >= 0.999
    other = np.bitwise_count(words[0][1:] ^ words[1][:-1]).sum(axis=1)
    assert (other <= E.sketch_limit(E.COSINE)).mean() <= 0.001
    assert E.sketch_limit(1.0) == 0


def test_first_common_set():
    a = np.array([[1, 5, 9], [5, 9, 9], [2, 5, 7], [5, 5, 5]])
    b = np.array([[5, 6, 7], [5, 6, 7], [2, 5, 9], [4, 5, 6]])
    assert E.first_common(a, b, 5).tolist() == [True, True, False, True]


def test_chain_longer_than_a_set(spark):
    """Neighbours on a circle link, so candidate sets overlap round the whole
    circle: more classes than a set may have, each link counted once."""
    rng = np.random.default_rng(6)
    p, q = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    turns = np.linspace(0, 2 * math.pi, 241)[:-1]
    rows = [(i, [float(x) for x in np.float32(math.cos(t) * p + math.sin(t) * q)], 1, 0, "") for i, t in enumerate(turns)]
    want = sorted(brute(rows))
    for cell_rows in (E.CELL_ROWS, 40, 2):
        got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), cell_rows=cell_rows).collect()
        assert {r["component_id"] for r in got} == {0}
        links = {r["vec_id"]: r["n_links"] for r in got}
        found = sum(links.values()) / sum(w[1] for w in want)
        assert found >= 0.99 and all(links[i] <= n for i, n, _ in want), (cell_rows, found)

import re
import random

import numpy as np
import pyarrow as pa

from tabrisk.llm import textscan as T

TEXTS = ["", None, "a b  a\tb", "Ünï cödé\x0bx", "  lead and trail \n", "one", "\x00z \x7f!", "é" * 50 + " A" * 40]


def test_words_match_the_patterns():
    for member, pattern, lower in ((T.NOT_SPACE, r"[^\x20\x09-\x0D]+", True),
                                   (T.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", True)):
        got = []
        for first, last, data, offsets in T.slices(pa.array(TEXTS), limit=20):
            s, e, h, d = T.words(data, offsets, member)
            for a, b, x, i in zip(s, e, h, d):
                w = bytes(data[a:b]).decode()
                got.append((first + i, w))
                assert T.word_hash(w) == int(x)
        want = [(i, w) for i, t in enumerate(TEXTS) for w in re.findall(pattern, t or "")]
        assert got == want


def test_hash_ignores_ascii_case_and_position(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 16)  # many blocks
    rng = random.Random(1)
    text = " ".join(rng.choice(["Alpha", "alpha", "beta", "ß"]) for _ in range(500))
    (_, _, data, offsets), = T.slices(pa.array([text]))
    s, e, h, _ = T.words(data, offsets)
    seen = {}
    for a, b, x in zip(s, e, h):
        seen.setdefault(bytes(data[a:b]).lower(), set()).add(int(x))
    assert len(seen) == 3 and all(len(v) == 1 for v in seen.values())


def test_grams_stay_inside_a_text():
    (_, _, data, offsets), = T.slices(pa.array(["a b c", "a b", "c a b c"]))
    _, _, h, doc = T.words(data, offsets)
    g, at = T.grams(h, doc, 3)
    assert at.tolist() == [0, 5, 6] and g[0] == g[2] and len(np.unique(g)) == 2


def test_code_points():
    data = np.frombuffer("aé€x".encode(), np.uint8)
    assert T.code_points(data)[[0, 1, 3, 6, 7]].tolist() == [0, 1, 2, 3, 4]

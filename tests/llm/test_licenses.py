import random
import re

from tabrisk.llm import licenses

SCHEMA = "doc_id long, text string, row long, label string, n_words int"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words = words_of(text)
    places = [(i, label) for label, phrase in licenses.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rng = random.Random(6)
    vocab = ["mit", "license", "apache", "general", "public", "MIT", "License,", "gpl", "été", "the", "of", "x1"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 20, 200]))) for _ in range(150)]
    out += [None, "", " ", "mit license", "MIT-License! mit\nlicense", "the Apache License, Version 2.0 of General Public License", "mitlicense mit licenses",
            "mit license " * 500, "x " * 60000 + "general public license"]
    return out


def test_base_against_brute_force(spark):
    rows = [(i, t, 1, "clash", 2) for i, t in enumerate(texts())] + [(3, texts()[3], 0, "", 0), (None, "mit license", 0, "", 0), (5, "mit license", 0, "", 0)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == \
        sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])


def test_notices_and_changed_notices(spark):
    mit = licenses.NOTICES[0][1]
    words = mit.split()
    changed = " ".join(words[:10] + ["indeed"] + words[10:20] + words[21:])  # a word more, then one less
    half = " ".join(words[: len(words) // 3])
    rows = [(1, "before " + mit + " after", 0, "", 0), (2, changed, 0, "", 0), (3, half, 0, "", 0), (4, "Licensed under CC BY-NC 4.0.", 0, "", 0),
            (5, "Licensed under the Apache License, Version 2.0.", 0, "", 0), (6, "This work is licensed under the GNU General Public License, version 3.", 0, "", 0),
            (7, "of the software and the of this without in the software", 0, "", 0), (8, mit + " between " + mit, 0, "", 0)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "cc-by-nc", 5: "apache", 6: "gpl", 7: "", 8: "mit"}
    assert got[1]["score"] == 1 and 0.9 < got[2]["score"] < 1 and got[3]["score"] == 0
    span = got[1]["spans"][0]
    assert (span["first"], span["last"]) == (1, len(words_of(mit)))
    assert len(got[8]["spans"]) == 2 and got[5]["base_labels"] == "apache" and got[6]["base_labels"] == "gpl"


def test_rolling_pairs_cover_the_text(spark):
    rows = [(i, t, 0, "", 0) for i, t in enumerate(texts()[:40])]
    keyed = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id as id", "doc_id as row", "text")
    got = {}
    for r in licenses.rolling(keyed).collect():
        got.setdefault(r["id"], []).append(r["pos"])
    for i, t, *_ in rows:
        n = len(words_of(t))
        assert sorted(got[i]) == sorted([-1 - n, *range(max(0, n - 1))])


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []

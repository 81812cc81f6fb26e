import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabrisk.llm import packing, pairing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, sequence_id string, rank int"
ODD = ["It's we'll 'S x's", "é Ȩ́a", " a b　c", "İstanbul ΑΣ Σ.", "a<|endoftext|>b <|startoftext|>",
       "한글 한", "\x00a\x1cb\x85c", "2²½ 12ab_c--d", "́abc x ́y", "\U0001f600\U0001f44dﬁ", "don't-'s!'s %'re", "",
       "a'b,'c ,'s", "a≠b"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(tokenizer, rows, got, sequence=4096):
    """An exact round trip: pieces cover each document, sequences are gapless."""
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(ids_of(tokenizer, r[1]))
    left = {}
    for r in got:
        assert r["length"] > 0
        own = texts[r["doc_id"]]
        # of repeated ids, the text that the piece is of
        match = [ids for ids in own if len(ids) == r["doc_tokens"] and zlib.crc32(
            np.array(ids[r["start"]: r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert match
        left[(r["doc_id"], tuple(match[0]))] = left.get((r["doc_id"], tuple(match[0])), 0) + r["length"]
    want = {}
    for doc, own in texts.items():
        for ids in own:
            want[(doc, tuple(ids))] = want.get((doc, tuple(ids)), 0) + len(ids)
    assert left == want
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["length"]))
    for doc, own in texts.items():
        if len(own) == 1:
            ends = sorted(spans[doc])
            assert ends[0][0] == 0 and ends[-1][1] == len(own[0]) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    return sum(r["length"] for r in got) / (sequence * len(by_sequence)) if got else 1.0


def test_ids_are_the_tokenizers(tokenizer):
    import pyarrow as pa
    from tabrisk.llm import textscan
    made = packing.WordIds(PATH)
    for _ in range(2):  # unknown words, then remembered ones
        for texts in (ODD, [x for x in ODD if "<|" not in x]):
            (_, _, data, offsets), = textscan.slices(pa.array(texts))
            ids, at = made.of(data, offsets)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(tokenizer, t) for t in texts]


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    import pyarrow as pa
    from tabrisk.llm import textscan
    monkeypatch.setattr(packing, "CACHE_WORDS", 8)
    made = packing.WordIds(PATH)
    for k in range(5):
        texts = [f"alpha beta{k} gamma{k}x", f"delta{k} alpha epsilon"]
        (_, _, data, offsets), = textscan.slices(pa.array(texts))
        ids, at = made.of(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(tokenizer, t) for t in texts]


def test_best_pattern_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        value, room = rng.random(6), 11

        def best(left, most=6):
            return max([0.0] + [value[i] + best(left - i - 1, i + 1) for i in range(min(most, left))])
        worth, counts = packing.best_pattern(value, room)
        assert np.isclose(worth, best(room)) and np.isclose(worth, counts @ value)
        assert (counts * np.arange(1, 7)).sum() <= room


def test_plan_covers_demand_with_little_waste():
    rng = np.random.default_rng(1)
    for n, room, unit in ((0, 16, 2), (1, 16, 2), (40, 16, 2), (5000, 64, 4), (30000, 256, 4), (-9000, 256, 4)):
        # the last: pieces of one length, of which only one fits a sequence whole
        size = np.full(9000, 131) if n < 0 else np.minimum(room, rng.lognormal(np.log(room / 4), 0.8, n).astype(int) + 1)
        demand = np.bincount(size - 1, minlength=room)
        plan = packing.Plan(demand, room, unit)
        bins = np.repeat(np.arange(room), demand)
        rank, _ = pairing.ranges(np.zeros(room, np.int64), demand)
        row, begin, end, sequence = plan.place(bins, rank)
        end = np.where(end < 0, bins[row] + 1, end)
        pieces = {}
        for r, b, e in sorted(zip(row.tolist(), begin.tolist(), end.tolist())):
            assert b == pieces.get(r, 0) and e > b and (b % unit == 0)
            pieces[r] = e
        assert len(pieces) == len(bins) and all(e == bins[r] + 1 for r, e in pieces.items())
        fill = np.bincount(sequence, end - begin) if len(row) else np.zeros(0)
        assert (fill <= room).all()
        if len(size) >= 5000:
            assert len(fill) <= 1.01 * size.sum() / room + 2


def test_crc_of_blocks_in_a_row():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 200, 64 * 9):
        raw = rng.integers(0, 50000, n).astype("<u4").tobytes()
        parts = np.array([zlib.crc32(raw[i:i + 256]) for i in range(0, len(raw), 256)])
        assert packing.joined_crc(parts, n - 64 * (len(parts) - 1), {}) == zlib.crc32(raw)


def test_pack_round_trip(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "don't", "über"]) for _ in range(rng.choice([0, 5, 300, 1500, 9000]))), "x", 1)
            for i in range(60)]
    rows += [(100 + i, t, "x", 1) for i, t in enumerate(ODD)] + [(7, "again", "x", 1), (7, "again", "x", 1), (200, None, None, None)]
    rows += [(300 + i, "the same text " * 50, "x", 1) for i in range(40)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert check(tokenizer, rows, got) > 0.95


def test_short_sequences(spark, tokenizer):
    rows = [(i, "word " * (i * 7 % 90), "", 0) for i in range(80)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, sequence=512, step=4).collect()
    assert check(tokenizer, rows, got, 512) > 0.85  # eight sequences, the last one part full


def fill(lengths):
    """Share of the sequences' tokens that hold pieces, after a check of the places."""
    demand = np.bincount(np.asarray(lengths) - 1, minlength=4096)
    plan = packing.Plan(demand, 4096, packing.CUT, packing.STEP)
    bins = np.repeat(np.arange(4096), demand)
    rank, _ = pairing.ranges(np.zeros(4096, np.int64), demand)
    row, begin, end, sequence = plan.place(bins, rank)
    end = np.where(end < 0, bins[row] + 1, end)
    assert (begin % packing.CUT == 0).all() and (end > begin).all()
    assert (np.bincount(row, end - begin, len(bins)) == bins + 1).all()
    used = np.bincount(sequence, end - begin)
    assert (used <= 4096).all()
    return used.sum() / (4096 * len(used))


def test_little_padding_in_tokens():
    rng = np.random.default_rng(7)
    for lengths in (np.full(200000, 1), np.full(100000, 17), np.full(60000, 50), np.full(30000, 257),
                    rng.integers(1, 300, 60000), rng.integers(1, 4097, 20000),
                    np.concatenate([np.ones(20000, int), rng.integers(200, 3000, 40000)])):
        assert fill(lengths) > 0.98, lengths[:3]


def test_many_empty_texts(spark, tokenizer):
    rows = [(i, None if i % 3 else "word " * 16, "", 0) for i in range(30000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert check(tokenizer, rows, got) > 0.95


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []

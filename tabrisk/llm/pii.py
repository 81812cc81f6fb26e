"""Personal data by rules and a character tagger.

Base rules find e-mail addresses, IP addresses, payment cards and phone
numbers.  A character-level bidirectional LSTM with a CRF (``tagger``) adds
spans that the rules miss: numbers without their prefix, cards side by side,
addresses with spaces.  It is trained on windows labelled by the base rules,
half of them with the spans rewritten in such forms (``rewrite``).

A text is cut into windows of ``WINDOW`` characters, one every ``STRIDE``.
Every span holds a digit or an ``@`` (the check of each kind asks for it), so
only windows with one are decoded.  Where windows overlap, a character takes
the label of the window in which it lies deeper, and spans are read from the
labels of the whole text, so one that runs over window edges is one span.  An
added span takes in the words at its edges, must pass its kind's check
(``checked``) and touch no base span.

Fitting takes a bounded sample (``sample_docs`` documents by a hash of their
text, ``max_windows`` distinct windows); scanning reads every whole text once,
without a shuffle, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
import sys
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import pairing, tagger, textscan

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 64
#: Documents and distinct windows that a fit may take, and windows decoded at a time.
SAMPLE_DOCS, MAX_WINDOWS, DECODED = 40_000, 1_500, 512
#: Windows that a fit is given at least, by rewriting spans of a small sample.
LEAST_WINDOWS = 1_500

# The domain after an @, an address of four parts, a run of digits with single
# separators, a number after a plus.  Possessive, and started at a run's first
# character only, so each is linear.
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))
LOCAL = textscan.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"._%+-"])
WORD = textscan.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
TRIGGER = textscan.byte_class([*range(0x30, 0x3A), 0x40])

#: Symbols: 0 past the text's end, 1 other control characters, 2 non-ASCII, 3 line end, then the printable ASCII ones.
SYMBOL = np.array([2 if b >= 0x80 else 3 if b == 0x0A else b - 28 if 0x20 <= b < 0x7F else 1 for b in range(256)], np.uint8)
SYMBOLS = 0x7F - 28
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(LABELS)] for a in range(LABELS)])


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_card(span: bytes) -> bool:
    digits = span.translate(None, NOT_DIGIT)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_address(parts: list[bytes]) -> bool:
    return all(len(x.lstrip(b"0")) <= 3 and int(x.lstrip(b"0") or b"0") <= 255 for x in parts)


def emails(text: bytes, data: np.ndarray) -> list[tuple[int, int]]:
    """Leftmost matches: an @ with the longest local part before it (back to
    the last match) and a domain after it."""
    out, last = [], 0
    outside = ~LOCAL[data]
    for at in np.flatnonzero(data == 0x40).tolist():
        m = DOMAIN.match(text, at + 1)
        if not m or at <= last:
            continue
        first = textscan.run_start(outside, at, last)
        if first < at:
            out.append((first, m.end()))
            last = m.end()
    return out


def base_spans(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches of one text, in bytes, sorted."""
    text = data.tobytes()
    out = [(0, a, b) for a, b in emails(text, data)] if b"@" in text else []
    out += [(1, *m.span()) for m in ADDRESS.finditer(text) if is_address(m[0].split(b"."))]
    out += [(2, *m.span()) for m in DIGITS.finditer(text) if is_card(m[0])]
    if b"+" in text:
        out += [(3, *m.span()) for m in PLUS.finditer(text) if 9 <= len(m[0].translate(None, NOT_DIGIT)) <= 15]
    return out


#: What a span that the tagger found is narrowed to, by kind.
FORMS = (re.compile(rb"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"), re.compile(rb"[0-9]+(?:\. ?[0-9]+){3}"),
         re.compile(rb"[0-9]"), re.compile(rb"[+(]?[0-9][0-9 ().-]*[0-9]"))


def checked(kind: int, span: bytes) -> list[tuple[int, int]]:
    """The parts of a span (start, end) that can be of its kind."""
    m = FORMS[kind].search(span)
    if not m:
        return []
    if kind == 2:
        return cards(span)
    digits = m[0].translate(None, NOT_DIGIT)
    ok = kind == 0 or (kind == 1 and is_address(m[0].replace(b" ", b"").split(b"."))) or (kind == 3 and 9 <= len(digits) <= 15)
    return [m.span()] if ok else []


def cards(span: bytes) -> list[tuple[int, int]]:
    """Leftmost runs of whole digit groups, one character apart, that are cards."""
    groups = [m.span() for m in re.finditer(rb"[0-9]+", span)]
    out, i = [], 0
    while i < len(groups):
        j = i
        while j < len(groups) and (j == i or groups[j][0] - groups[j - 1][1] == 1) and groups[j][1] - groups[i][0] <= 37:
            if is_card(span[groups[i][0]: groups[j][1]]):
                out.append((groups[i][0], groups[j][1]))
                i = j
                break
            j += 1
        i += 1
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


class Windows:
    """The windows with a digit or an @ of some texts: ``x`` their symbols
    [window, character]; texts are seen as characters (first bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = (data & 0xC0) != 0x80
        self.points = textscan.code_points(data)
        self.edges = self.points[offsets]
        chars = data[lead]
        hit = np.flatnonzero(TRIGGER[chars])
        doc = np.searchsorted(self.edges, hit, "right") - 1
        rel = hit - self.edges[doc]
        most = np.maximum(0, -(-(np.diff(self.edges) - WINDOW) // STRIDE))[doc]
        first = np.maximum(0, (rel - WINDOW) // STRIDE + 1)
        last = np.minimum(rel // STRIDE, most)
        k, own = pairing.ranges(np.minimum(first, last), last - np.minimum(first, last) + 1)
        # a text's windows have numbers of their own, one apart from the next text's
        base = np.append(0, np.cumsum(np.diff(self.edges) // STRIDE + 2))
        code = np.unique(base[doc[own]] + k)
        self.doc = np.searchsorted(base, code, "right") - 1
        self.start = self.edges[self.doc] + (code - base[self.doc]) * STRIDE
        self.end = np.minimum(self.start + WINDOW, self.edges[self.doc + 1])
        at = self.start[:, None] + np.arange(WINDOW)
        symbols = SYMBOL[chars] if len(chars) else np.zeros(1, np.uint8)
        self.x = np.where(at < self.end[:, None], symbols[np.minimum(at, len(symbols) - 1)], 0)
        # characters that lie deeper in a neighbour are the neighbour's
        near = np.diff(code) == 1
        shared = (WINDOW - STRIDE) // 2
        self.own_from = self.start + np.where(np.append(False, near), shared, 0)
        self.own_to = self.end - np.where(np.append(near, False), np.maximum(0, self.end - self.start - STRIDE - shared), 0)

    def spans(self, labels: np.ndarray, n_chars: int):
        """(kind, start, end) in characters of the slice, from window labels."""
        whole = np.zeros(n_chars + 1, np.int8)
        at, own = pairing.ranges(self.own_from, self.own_to - self.own_from)
        whole[at] = labels[own, at - self.start[own]]
        kind = (whole - 1) // 2
        fresh = (whole > 0) & ((whole % 2 == 1) | np.append(True, kind[1:] != kind[:-1]))
        fresh[self.edges[:-1]] |= whole[self.edges[:-1]] > 0
        begin = np.flatnonzero(fresh)
        stop = np.append(True, (whole[1:] == 0)) | fresh
        stop[self.edges] = True
        stops = np.flatnonzero(stop)
        return kind[begin], begin, stops[np.searchsorted(stops, begin, "right")] if len(begin) else begin


def added(data: np.ndarray, offsets: np.ndarray, model: tagger.Tagger):
    """For each text, (kind, start, end) in characters of the tagger's checked spans."""
    w = Windows(data, offsets)
    out: dict[int, list] = {}
    if not len(w.x):
        return out
    labels = np.concatenate([model.decode(w.x[i: i + DECODED]) for i in range(0, len(w.x), DECODED)])
    kinds, starts, ends = w.spans(labels, len(w.points) and int(w.points[-1]))
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    # a span takes in the whole words at its edges
    word = np.append(WORD[data[(data & 0xC0) != 0x80]], False)
    breaks = np.unique(np.concatenate([np.flatnonzero(word[1:] != word[:-1]) + 1, w.edges]))
    for kind, a, b in zip(kinds.tolist(), starts.tolist(), ends.tolist()):
        if word[a]:
            a = int(breaks[np.searchsorted(breaks, a, "right") - 1])
        if word[b - 1]:
            b = int(breaks[np.searchsorted(breaks, b, "left")])
        doc, at = int(np.searchsorted(w.edges, a, "right")) - 1, int(lead[a])
        for part in checked(kind, data[lead[a]: lead[b]].tobytes()):
            out.setdefault(doc, []).append((kind, *[int(w.points[at + x]) - int(w.edges[doc]) for x in part]))
    return out


def rewrite(kind: int, span: str, rng: random.Random) -> list[str]:
    """The span in another form, with other digits and letters; at times two cards."""
    digit = lambda m: str(rng.randint(0, 9))
    if kind == 0:
        name, _, host = re.sub("[0-9]", digit, span).partition("@")
        name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if x.isalpha() else x for x in name)
        return [rng.choice([f"{name}@{host}", f"{name} @ {host}", f"{name}@{host.partition('.')[0]}"])]
    if kind == 1:
        return [rng.choice([".", ".", ". "]).join(str(rng.randint(0, 255)) for _ in range(4))]
    if kind == 2:
        gap, out = rng.choice(["", " ", "-", "."]), []
        for _ in range(rng.randint(1, 2)):
            digits = [rng.randint(0, 9) for _ in range(sum(x.isdigit() for x in span))]
            digits[-1] = next(d for d in range(10) if luhn(bytes(48 + x for x in [*digits[:-1], d])))
            text = "".join(map(str, digits))
            out.append(gap.join(text[i: i + 4] for i in range(0, len(text), 4)))
        return out
    area, mid, end = rng.randint(100, 999), rng.randint(100, 999), rng.randint(1000, 9999)
    return [rng.choice([re.sub("[0-9]", digit, span), f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"00{rng.randint(1, 99)} {area} {mid} {end}"])]


def examples(texts: list[str], spans: list[list], rng: random.Random, least: int = LEAST_WINDOWS):
    """Symbol and label rows: the given windows, and copies with rewritten spans."""
    xs, ys = [], []

    def add(text, marks):
        x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int8)
        points = [min(ord(c), 0x80) for c in text[:WINDOW]]
        x[: len(points)] = SYMBOL[points]
        for kind, a, b, cut in marks:
            y[a:b] = 2 + 2 * kind
            if a < WINDOW and not cut:
                y[a] -= 1
        xs.append(x)
        ys.append(y)

    for text, own in zip(texts, spans):
        add(text, own)
    marked = [(t, s) for t, s in zip(texts, spans) if s]
    rounds = max(1, -(-(least - len(texts)) // len(marked))) if marked else 0
    for _ in range(rounds):
        for text, own in marked:
            out, marks, at = "", [], 0
            for kind, a, b, cut in own:
                out += text[at:a]
                for j, new in enumerate([text[a:b]] if cut or b == len(text) else rewrite(kind, text[a:b], rng)):
                    out += " " * (j > 0)
                    marks.append((kind, len(out), len(out) + len(new), cut))
                    out += new
                at = b
            add(out + text[at:], marks)
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def labelled_windows(data: np.ndarray, offsets: np.ndarray):
    """(text, marks) of every window with a digit or an @; marks are
    kind:start:end:cut by start, cut = begun before the window."""
    w = Windows(data, offsets)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    base = {}
    for i, doc in enumerate(w.doc.tolist()):
        if doc not in base:
            lo, hi = offsets[doc], offsets[doc + 1]
            taken, found = [], []
            # a card inside a phone number is part of the phone number
            for k, a, b in sorted(base_spans(data[lo:hi]), key=lambda s: (s[0] == 2, s[1])):
                a, b = int(w.points[lo + a]), int(w.points[lo + b])
                if all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
                    found.append((a, b, k))
            base[doc] = sorted(found)
        first, last = int(w.start[i]), int(w.end[i])
        marks = [f"{k}:{max(a, first) - first}:{min(b, last) - first}:{int(a < first)}" for a, b, k in base[doc] if a < last and b > first]
        yield data[at[first]: at[last]].tobytes().decode(), ",".join(marks)


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
        max_windows: int = MAX_WINDOWS) -> tagger.Tagger | None:
    """A tagger from the sample's windows, or None if no base span is in them."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    text = docs.select(F.col(text_col).alias("text")).where("text is not null")
    # by content, so that copies come together and count once
    text = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in textscan.slices(batch.column(0)):
                rows = set(labelled_windows(data, offsets))
                if rows:
                    texts, marks = zip(*sorted(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(marks)], names=["text", "marks"])

    found = text.mapInArrow(run, "text string, marks string").distinct()
    got = found.orderBy(F.xxhash64("text", "marks"), "text", "marks").limit(max_windows).toArrow()
    texts, marks = got.column("text").to_pylist(), got.column("marks").to_pylist()
    spans = [[tuple(map(int, x.split(":"))) for x in m.split(",")] if m else [] for m in marks]
    if not any(spans):
        return None
    x, y = examples(texts, spans, random.Random(tagger.SEED))
    return tagger.train(x, y, SYMBOLS, ALLOWED)


FINDINGS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: tagger.Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, base digest, all spans) of every row of ``docs``.

    A null or empty text has no span.  Repeated rows and ids each get a row;
    null ids stay null; extra columns are ignored; an empty table gives an
    empty result; a text of any length is scanned whole, in linear time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in textscan.slices(batch.column(1)):
                hit = np.flatnonzero(TRIGGER[data])
                busy = set((np.searchsorted(offsets, hit, "right") - 1).tolist())
                more = added(data, offsets, model) if model is not None and busy else {}
                for i in range(len(offsets) - 1):
                    if i not in busy:
                        out.append(nothing)
                        continue
                    text = data[offsets[i]: offsets[i + 1]]
                    at = textscan.code_points(text)
                    base = [(k, int(at[a]), int(at[b])) for k, a, b in base_spans(text)]
                    starts, ends = merged((a, b) for _, a, b in base)
                    # added spans touch no base span: none ends between its start and the last start before its end
                    extra = [s for s in more.get(i, ()) if bisect_right(ends, s[1]) == bisect_left(starts, s[2])]
                    out.append((*[sum(s[0] == k for s in base) for k in range(4)],
                                hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra)))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()] * 2)]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                                 names=["id", *[x.split()[0] for x in FINDINGS.split(", ")]])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                .mapInArrow(run, f"id {kind}, {FINDINGS}").withColumnRenamed("id", id_col))


def merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of intervals, sorted and apart."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends

"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256).  A ledger, a
Parquet table in a shared folder, keeps the findings of each (blob, rule
version) pair.  A run takes the versions' distinct blobs, drops the pairs that
the ledger has, scans only the rest, appends their findings and joins the
findings of all blobs back to all versions (paths).

Copies meet before the shuffle (a partial aggregate on the blob), so a blob
with a third of all rows is moved and scanned once for each map task at most;
the join back is a plain one on written tables, whose hot keys AQE splits.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import textscan
from tabrisk.llm.spark_util import free_names, shared_folder, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base kinds in the order of equal starts, then added kinds
# with well-known public token shapes.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ADDED = (
    ("pem", b"-----BEGIN ", re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("forge", b"gh", re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", b"xox", re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("maps", b"AIza", re.compile(rb"AIza[A-Za-z0-9_-]{35}")),
)
#: Rules that are searched from their middle: a rare mark, the run before it, its first part, and what follows.
INNER = (
    ("jwt", b".eyJ", re.compile(rb"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
     textscan.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"_-"]), re.compile(rb"eyJ[A-Za-z0-9_-]{8}")),
    ("login", b"://", re.compile(rb"://[^\s/:@]++:[^\s/:@]{3,}+@"),
     textscan.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *b"+.-"]), re.compile(rb"[a-z]")),
)
KINDS = ("assign", "access", "hex", *[k for k, _, _ in ADDED], *[x[0] for x in INNER])
#: Changes whenever a rule changes: findings of another version don't count.
RULES_VERSION = hashlib.sha256(b"\n".join([b"2", ASSIGN.pattern, ACCESS.pattern, *[r.pattern for _, _, r in ADDED],
                                           *[x for i in INNER for x in (i[2].pattern, i[4].pattern)]])).hexdigest()[:16]
HEX = textscan.byte_class([*range(0x30, 0x3A), *range(0x61, 0x67)])


def inner(text: bytes, data: np.ndarray, mark: bytes, after: re.Pattern, before: np.ndarray, first: re.Pattern):
    """Leftmost matches of a rule, found at its mark: every run before a mark
    is read once, so the time is linear in the text."""
    out, last, at = [], 0, text.find(mark)
    outside = ~before[data]
    while at >= 0:
        m = after.match(text, at)
        if m and at > last:
            start = first.search(text, textscan.run_start(outside, at, last), at)
            if start:
                out.append((start.start(), m.end()))
                last = m.end()
        at = text.find(mark, at + 1)
    return out


def scan(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all findings in one text, in code points,
    sorted by start and kind."""
    text = data.tobytes()
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    s, e = textscan.runs(data, np.array([0, len(data)]), HEX)
    long = e - s >= 32
    found += [(int(a), int(b), 2) for a, b in zip(s[long], e[long])]
    for i, (_, hint, rule) in enumerate(ADDED, 3):
        if hint in text:
            found += [(m.start(), m.end(), i) for m in rule.finditer(text)]
    for i, (_, mark, after, before, first) in enumerate(INNER, 3 + len(ADDED)):
        if mark in text:
            found += [(a, b, i) for a, b in inner(text, data, mark, after, before, first)]
    if not found:
        return []
    at = textscan.code_points(data)
    return sorted((int(at[a]), int(at[b]), k) for a, b, k in found)


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1])))


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob_id, findings) of each row of ``blobs`` (blob_id, text)."""
    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in textscan.slices(batch.column(1)):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    found = scan(data[a:b])
                    base = [x for x in found if x[2] < 3]
                    out.append((*[sum(x[2] == k for x in base) for k in range(3)],
                                hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                             names=["blob_id", *[x.split()[0] for x in FINDINGS.split(", ")]])

    return blobs.select("blob_id", "text").mapInArrow(run, "blob_id string, " + FINDINGS)


def ledger_table(spark, ledger: str, rules: str) -> DataFrame | None:
    """Findings that the ledger has for a rule version, or None.  A blob that
    two runs scanned at a time counts once: its findings are the same."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    return (spark.read.schema(f"blob_id string, {FINDINGS}, rules string").parquet(ledger)
                 .where(F.col("rules") == rules).drop("rules").dropDuplicates(["blob_id"]))


def scan_versions(versions: DataFrame, ledger: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", rules: str = RULES_VERSION) -> DataFrame:
    """(id, blob_id, findings) of every row of ``versions``.

    ``ledger`` is the folder of the ledger (a fresh one in the shared folder if
    not given); a later run with the same folder scans new blobs only.  A null
    text is the empty blob, without findings.  Repeated rows and ids each get
    a row; extra columns are ignored; an empty table gives an empty result; a
    very long text is scanned whole, in linear time.
    """
    spark = versions.sparkSession
    ledger = ledger or shared_folder(spark, "ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    addressed = versions.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob_id"), text.alias("text"))
    paths = written(addressed.select("id", "blob_id"), "paths")
    known = ledger_table(spark, ledger, rules)
    blobs = addressed.select("blob_id", "text")
    if known is not None:
        blobs = blobs.join(known.select("blob_id"), "blob_id", "left_anti")
    blobs = blobs.groupBy("blob_id").agg(F.first("text").alias("text"))
    (scan_blobs(blobs).withColumn("rules", F.lit(rules))
        .write.mode("append").partitionBy("rules").parquet(ledger))
    known = ledger_table(spark, ledger, rules)
    return paths.join(known, "blob_id", "left").select(F.col("id").alias(id_col), "blob_id",
                                                       *[x.split()[0] for x in FINDINGS.split(", ")])


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (spans that overlap
    are one), and n_chars, if there, counted anew.  Rows are matched on the id
    and the content, so repeated ids (and null ones) keep their own texts;
    others stay as they are, also null texts.  Columns of any name stay; an
    empty table stays empty."""
    own, theirs, blob, spans = free_names(docs, "docs_blob", "id", "blob", "spans")
    marked = findings.where("spans != ''").select(F.col(id_col).alias(theirs), F.col("blob_id").alias(blob),
                                                  F.col("spans").alias(spans)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(theirs)) & (F.col(own) == F.col(blob))
    joined = (docs.withColumn(own, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
                  .join(marked, same, "left").select(*docs.columns, spans))
    names = docs.columns
    at = names.index(text_col)
    count = names.index("n_chars") if "n_chars" in names else -1

    def redact_rows(batches):
        for batch in batches:
            spans = batch.column(len(batch.columns) - 1)
            found = spans.is_valid()
            columns = list(batch.columns[:-1])
            if pc.any(found).as_py():
                texts = [cut(t, s, mark) for t, s in zip(columns[at].filter(found).to_pylist(), spans.filter(found).to_pylist())]
                columns[at] = pc.replace_with_mask(columns[at], found, pa.array(texts, columns[at].type))
                if count >= 0:
                    sizes = pa.array([len(t) for t in texts], columns[count].type)
                    columns[count] = pc.replace_with_mask(columns[count], found, sizes)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(redact_rows, docs.schema)


def cut(text: str, spans: str, mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])

"""The registered query of each operator: the operator on its whole table,
with production parameters, and the columns of its result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.llm import (cotraining, dualtree, embed_dedup, html_extract, licenses, mixing, packing, pii,
                         quality_rules, secrets, simhash, spelling, toxicity)
from tabrisk.llm.spark_util import table

VOCABULARY = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, n-gram log-likelihood ratio and decision of all documents."""
    return quality_rules.rate(table(spark, sf_dir, "documents", "doc_id", "text"),
                              table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, keeping probability and decision of all documents."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 6).alias("p"), "kept")


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by two co-trained views."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, by way of a new ledger."""
    return secrets.scan_versions(table(spark, sf_dir, "documents", "doc_id", "text")).drop("blob_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and decision of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of all embeddings."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base rules and the character tagger."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.scan(docs, pii.fit(docs))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return dualtree.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_quality_rules, op3_html_extraction, op4_mixing, op5_cotraining, op6_license_scans,
    op7_secret_scans, op8_simhash, op9_toxicity, op10_embedding_dedup, op11_spelling_variants,
    op12_personal_data, op13_lexical_search)}


def _mixing_sql() -> str:
    """op4 in SQL: cells, ``SWEEPS`` rounds of raking as chained window sums,
    calibration as a running sum over the cells, and the id's hash."""
    from tabrisk.llm.mixing import BUDGET, DIMS, POWER, SWEEPS
    text = "coalesce(text, '')"
    parts = [f"""d AS (SELECT doc_id, source, lang,
  CAST(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
  CASE WHEN length({text}) = 0 THEN 'prose'
    WHEN 20 * length(regexp_replace({text}, '[^#*$%&]', '', 'g')) >= length({text}) THEN 'symbols'
    WHEN 3 * length(regexp_replace({text}, '[^A-Z]', '', 'g')) >= length({text}) THEN 'caps'
    WHEN 50 * length(regexp_replace({text}, '[^|]', '', 'g')) >= length({text}) THEN 'table' ELSE 'prose' END AS topic,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(16 ** 13)} AS u
  FROM documents)""",
             """c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t FROM d GROUP BY ALL)"""]
    shares = []
    for k in DIMS:
        shares.append(f"s_{k} AS (SELECT {k}, pow(sum(t) / (SELECT sum(t) FROM c), {POWER}) AS s FROM c GROUP BY {k})")
        shares.append(f"g_{k} AS (SELECT {k}, s / (SELECT sum(s) FROM s_{k}) * (SELECT sum(t) FROM c) AS g FROM s_{k})")
    parts += shares
    joins = " ".join(f"JOIN g_{k} ON c.{k} IS NOT DISTINCT FROM g_{k}.{k}" for k in DIMS)
    parts.append(f"w0 AS (SELECT c.*, t AS w, {', '.join(f'g_{k}.g AS goal_{k}' for k in DIMS)} FROM c {joins})")
    step = 0
    for _ in range(SWEEPS):
        for k in DIMS:
            parts.append(f"w{step + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {k}) > 0 THEN "
                         f"w * goal_{k} / sum(w) OVER (PARTITION BY {k}) ELSE 0 END AS w) FROM w{step})")
            step += 1
    parts.append(f"r AS (SELECT *, CASE WHEN t > 0 THEN w / t END AS ratio FROM w{step})")
    parts.append("o AS (SELECT *, coalesce(sum(t) OVER before, 0) AS whole, sum(w) OVER rest AS left_w FROM r "
                 "WINDOW before AS (ORDER BY ratio DESC NULLS FIRST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
                 "rest AS (ORDER BY ratio DESC NULLS FIRST, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
    parts.append(f"k AS (SELECT ({BUDGET} * (SELECT sum(t) FROM c) - whole) / left_w AS s FROM o WHERE ratio IS NOT NULL AND left_w > 0 "
                 f"AND ({BUDGET} * (SELECT sum(t) FROM c) - whole) / left_w * ratio <= 1 ORDER BY ratio DESC LIMIT 1)")
    parts.append("p AS (SELECT source, lang, topic, CASE WHEN ratio IS NULL THEN 1.0 ELSE "
                 "least(1.0, greatest((SELECT s FROM k), 0) * ratio) END AS p FROM r)")
    return ("WITH " + ",\n".join(parts) + "\nSELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p.p, 6) AS p, "
            "d.u < p.p AS kept FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang "
            "AND d.topic = p.topic")


def _spelling_sql() -> str:
    """op11 in SQL: CRC-32 as a fold over bytes, near words by equal strings
    after a deletion, forms by a window, roots by recursion."""
    return """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
           lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2),
           lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
           lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest
         FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form,
            CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
ways AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
         UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON ways.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT ways.word, ways.at FROM ways JOIN forms ON ways.at = forms.word WHERE forms.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e USING (word)"""


_SEARCH_SQL = """
WITH words AS (
  SELECT kind, id, word, count(*) AS tf FROM (
    SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark))
  GROUP BY ALL),
size AS (SELECT id AS doc_id, CAST(sum(tf) AS BIGINT) AS n FROM words WHERE kind = 'd' GROUP BY id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
length AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM size, whole),
weight AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM words, whole WHERE kind = 'd' GROUP BY word, n_docs),
scores AS (
  SELECT i.id AS item_id, d.id AS doc_id, CAST(sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m))) AS BIGINT) AS score
  FROM words i JOIN words d ON i.word = d.word AND i.kind = 'i' AND d.kind = 'd'
    JOIN weight ON weight.word = i.word JOIN length ON length.doc_id = d.id
  GROUP BY ALL),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
         FROM scores WHERE score > 0)
SELECT * FROM best WHERE rank <= 20"""


ORACLE = {"op4_mixing": _mixing_sql(), "op11_spelling_variants": _spelling_sql(), "op13_lexical_search": _SEARCH_SQL}

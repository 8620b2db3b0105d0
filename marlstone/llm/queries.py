"""The queries of this subpackage, on the tables documents and benchmark, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, langid, licenses, media, packing, ppm, quality, simhash, substrings, tokenfile
from marlstone.llm.common import delete_at_end, shared_dir


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insult labellers learn from the labels of documents whose crc32(doc_id as text) mod 4 is not 2."""
    return quality.classify(_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels").where(~langid.held_out()))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary(WORD_BPE))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in the directory of their source under their id as text; a null source or id is the word null."""
    docs = _table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    docs = docs.select("doc_id", "text", F.concat_ws("/", part("source"), part("doc_id")).alias("path"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return licenses.scan(docs).select(F.when(name != "null", name.cast(docs.schema["doc_id"].dataType)).alias("doc_id"), "license", "score", "method", "origin")


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    found = media.transport_streams(_table(spark, sf_dir, "documents"), path)
    delete_at_end(spark, path)
    return found


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    found = tokenfile.token_planes(_table(spark, sf_dir, "documents"), path, _vocabulary(WORD_BPE))
    delete_at_end(spark, path)
    return found


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = langid.held_out(parts=5, part=1)
    found = ppm.score(_table(spark, sf_dir, "documents"), ~held_out, class_col="lang")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS k
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON p.k = v.k AND p.n = v.n),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(0, n)) AS u(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM docs, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 20)) AS u(j)),
words AS (SELECT doc_id, p, w[p] AS x FROM docs, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# The same sums as in licenses.py: templates, term weights, cosines, then the directory of each document, its source.
OP5_SQL = rf"""
WITH templates AS (SELECT * FROM (VALUES {", ".join("({}, '{}', '{}')".format(i, a, b.lower()) for i, (a, b) in enumerate(licenses.TEMPLATES))}) AS t(template, license, seg)),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(seg, '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + len(licenses.TEMPLATES)} / (count(*) + 1)) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT term, license, template, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
low AS (SELECT coalesce(source, 'null') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS path, lower(text) AS low FROM documents WHERE {" OR ".join(f"contains(lower(text), '{c}')" for c in licenses.CUES)}),
segs AS (
  SELECT DISTINCT path, 'header' AS kind, seg FROM (SELECT path, unnest(string_split(low, chr(10))) AS seg FROM low) WHERE {" OR ".join(f"contains(seg, '{c}')" for c in licenses.CUES)}
  UNION ALL SELECT path, 'file', low FROM low),
terms AS (SELECT path, kind, seg, term, count(*) AS tf FROM (SELECT path, kind, seg, unnest(regexp_extract_all(seg, '[a-z0-9]+')) AS term FROM segs) GROUP BY ALL),
w AS (SELECT t.*, tf * coalesce(idf, ln({1.0 + len(licenses.TEMPLATES)}) + 1) AS w FROM terms t LEFT JOIN idf USING (term)),
norms AS (SELECT path, kind, seg, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dots AS (SELECT path, kind, seg, license, template, sum(w * weight) AS dot FROM w JOIN tw USING (term) GROUP BY ALL),
scored AS (SELECT path, kind, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (path, kind, seg)),
own AS (SELECT path, license, score, kind FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, kind, license) AS nth FROM scored WHERE score >= {licenses.LEAST}) WHERE nth = 1),
covered AS (SELECT source, license, score FROM (SELECT string_split(path, '/')[1] AS source, license, score, row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY score DESC, license) AS nth FROM scored WHERE kind = 'file' AND score >= {licenses.LEAST}) WHERE nth = 1)
SELECT d.doc_id, coalesce(o.license, c.license) AS license, coalesce(o.score, c.score) AS score,
  CASE WHEN o.license IS NOT NULL THEN o.kind WHEN c.license IS NOT NULL THEN 'inherited' END AS method,
  CASE WHEN o.license IS NULL AND c.license IS NOT NULL THEN c.source END AS origin
FROM documents d LEFT JOIN own o ON o.path = coalesce(d.source, 'null') || '/' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') LEFT JOIN covered c ON c.source = coalesce(d.source, 'null')
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op5_licenses": OP5_SQL, "op7_substrings": OP7_SQL}

"""Registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.llm.caps import near_vectors
from lamella.llm.decontaminate import contaminated
from lamella.llm.filter_audit import filter_audit
from lamella.llm.fingerprints import compared_fingerprints
from lamella.llm.line_dedup import without_common_blocks
from lamella.llm.mixing import mixed, tempered
from lamella.llm.passages import repeated_passages
from lamella.llm.phrases import collocations
from lamella.llm.pseudonyms import pseudonymise
from lamella.llm.quality import fold, train, with_score
from lamella.llm.secrets import secret_spans
from lamella.llm.simhash import near_groups
from lamella.llm.url_filter import url_filter

#: Rules of the address filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Where the session names the secret key of the pseudonyms, and the key that this query takes where none is named.
PSEUDONYM_KEY = ("spark.lamella.pseudonyms.key", "for trials only")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = without_common_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_fingerprints(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs, tempered(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymised text of every document, with counts by kind."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(*PSEUDONYM_KEY))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text"), model).drop("text")
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS words
  FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS f FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, f AS a FROM f WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.words[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.words[c.j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(words[1:2], ' ') AS phrase FROM candidates WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(words[2:3], ' ') FROM candidates WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN inside i ON c.k = 2 AND i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.a IS NULL OR 100 * i.a < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
first AS (SELECT text, min(doc_id) AS doc_id FROM d GROUP BY text),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END ||
         CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END ||
         CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 'C' ELSE '' END ||
         CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END ||
         CASE WHEN d.doc_id > first.doc_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN first ON d.text = first.text LEFT JOIN known ON d.doc_id = known.doc_id),
sums AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(o, letter)),
steps AS (SELECT o AS filter_order, step, o[step] AS letter, o[1:step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
each AS (
  SELECT *, contains(fails, letter) AS own, length(translate(earlier, fails, '')) < step - 1 AS gone
  FROM sums, steps)
SELECT part, filter_order, step::INTEGER AS step,
       coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost,
       (sum(coalesce(sum(n) FILTER (own AND NOT gone), 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM each GROUP BY part, filter_order, step, letter
"""

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_fingerprints, op3_secrets, op4_decontamination, op5_mixing, op6_simhash, op7_pseudonyms, op8_url_filter, op9_passages, op10_quality, op11_collocations, op12_caps, op13_filter_audit)}
ORACLE_SQL = {"op8_url_filter": OP8_SQL, "op11_collocations": OP11_SQL, "op12_caps": OP12_SQL, "op13_filter_audit": OP13_SQL}

"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, dartminhash, decontam, embeddings, language, lines, mixing, pii, ppm, shards, urls, variants,
               wrapper)
from .common import read_table

#: listed URL rules (host, path, verdict), fixed by the query's contract
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MIX_WEIGHTS, MIX_REPEAT = (5, 2, 1), 3
SHARDS = 24


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's url.  Training labels are those of the document
    whose number the url's path names; a page is to be blocked if that document
    is labelled toxic or of low quality."""
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.url_path(F.col("url")), r"/([0-9]{1,18})(?:[^0-9]|$)", 1)
    labelled = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    labelled = labelled.join(labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")),
                             "doc_id").select("url", "block")
    return urls.judge_urls(pages, labelled, URL_RULES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    return (language.identify(docs, docs.where(~out))
            .select("doc_id", out.alias("held_out"), "lang_pred", "score"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.95)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and disclosing terms of every document."""
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.span_text(pii.KINDS), 256).alias("base_sha256"),
                        pii.span_text((*pii.KINDS, "term")).alias("spans"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return (mixing.pareto_mix(docs, MIX_WEIGHTS, MIX_REPEAT)
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and byte-model scores of every document, learned from those not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ppm.held_out(F.col("doc_id"))
    scores = ppm.score_documents(docs, docs.where(~out))
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.main_text(read_table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: one row per document and item."""
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``bytes``."""
    placed = shards.byte_shards(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: class_id is the smallest doc_id."""
    found = dartminhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return variants.spelling_variants(read_table(spark, sf_dir, "documents"), typo_every=variants.TYPO_EVERY)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring phrases of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and a digest of the text that is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_url_rules, op2_language_id, op3_embedding_dedup, op4_personal_data, op5_source_mix, op6_lm_score, op7_page_text,
    op8_decontaminate, op9_byte_shards, op10_near_dedup, op11_spelling_variants, op12_collocations, op13_line_dedup)}
#: crc32 of a text: a CTE ``crc_table(t)`` and the expression for a column
CRC_TABLE = """
crc_rows AS (SELECT i, list_reduce(list_concat([i::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
             FROM range(256) r(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_rows)"""


def crc32_sql(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(octet_length(encode({text}))),
                   lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT)),
                   lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::INT])), 4294967295::UBIGINT)"""


ORACLES: dict[str, str] = {
    "op11_spelling_variants": f"""
WITH {CRC_TABLE},
runs AS (SELECT CAST(doc_id AS VARCHAR) || ':' || run AS k, run, COUNT(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql('k')} AS h FROM runs, crc_table),
words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                      ELSE run END AS word, SUM(n)::BIGINT AS n FROM hashed GROUP BY 1),
v AS (SELECT word, n FROM words WHERE length(word) >= 5 AND n >= 3),
gone AS (SELECT DISTINCT word, left(word, i::INT) || substr(word, i::INT + 2) AS rest
         FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
holes AS (SELECT word, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS rest
          FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word AS x, b.word AS y FROM holes a JOIN holes b ON a.rest = b.rest AND a.word <> b.word
         UNION SELECT g.word, v.word FROM gone g JOIN v ON v.word = g.rest
         UNION SELECT v.word, g.word FROM gone g JOIN v ON v.word = g.rest),
best AS (SELECT x, COUNT(*) AS n_near, arg_min(struct_pack(y := y, m := w.n), struct_pack(m := -w.n, y := encode(y))) AS b
         FROM near JOIN v w ON w.word = y GROUP BY x),
formed AS (SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.y END AS form,
                  CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n FROM v LEFT JOIN best ON x = word),
chain AS (SELECT word, COALESCE(form, word) AS root, form IS NOT NULL AS more FROM formed),
up AS (WITH RECURSIVE r AS (
         SELECT word, root, more, 0 AS hop FROM chain
         UNION ALL SELECT r.word, c.root, c.more, hop + 1 FROM r JOIN chain c ON c.word = r.root WHERE r.more)
       SELECT word, arg_max(root, hop) AS root FROM r GROUP BY word)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN up ON up.word = formed.word
""",
    "op12_collocations": """
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, p, words
  FROM (SELECT lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words
        FROM (SELECT lang, unnest(parts) AS piece, generate_subscripts(parts, 1) + 100000000 * rid AS p
              FROM (SELECT lang, row_number() OVER () AS rid,
                           regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[.,;:!?\\x0A-\\x0D]') AS parts FROM documents)))),
w AS (SELECT lang, words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3
      FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces)),
f1 AS (SELECT lang, w1, COUNT(*) AS c FROM w GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, COUNT(*) AS c FROM w WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, COUNT(*) AS c FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 10),
total AS (SELECT lang, SUM(c)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.c AS a, 1 AS cut_at, x.c AS l, y.c AS r
         FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
         WHERE f2.c >= 10 AND NOT EXISTS (
           SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.c >= 50 * f2.c)
         AND NOT EXISTS (
           SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.c >= 50 * f2.c)
         UNION ALL
         SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.c, 1, x.c, y.c
         FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
         UNION ALL
         SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.c, 2, x.c, y.c
         FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
left_over AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
""",
    "op13_line_dedup": """
WITH l AS (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
           FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
shared AS (SELECT k, MAX(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
           GROUP BY k HAVING COUNT(DISTINCT doc_id) >= 5)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (keeper <> doc_id) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared ON shared.k = keyed.k GROUP BY doc_id, rid
""",
    "op9_byte_shards": f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, COALESCE(octet_length(encode(text)), 0) + 8 AS size, {crc32_sql('text')} AS c FROM documents, crc_table),
placed AS (SELECT *, SUM(size) OVER along AS upto, row_number() OVER along AS nr, SUM(size) OVER () AS total FROM d
           WINDOW along AS (ORDER BY doc_id NULLS FIRST, c NULLS FIRST ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, LEAST((2 * upto - size) * 24 // (2 * total), 23) AS shard FROM placed)
SELECT doc_id, size, c::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       nr - MIN(nr) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM cut
""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
           AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
near AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM (FROM v WHERE fine) a JOIN (FROM v WHERE fine) b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y),
part AS (SELECT x, MIN(y) AS low FROM reach GROUP BY x)
SELECT vec_id, (SELECT COUNT(*) FROM near WHERE near.x = vec_id) AS n_links, low AS component_id, low = vec_id AS kept
FROM v JOIN part ON part.x = vec_id
""",
    "op5_source_mix": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':mix:' || md5(COALESCE(text, ''))), 1, 13)
               AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents),
leveled AS (SELECT *, CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END AS level FROM d),
src AS (SELECT source, SUM(size) AS z,
               [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
fill AS (SELECT *, (SUM(z) OVER () - COALESCE(SUM(3 * z) OVER before, 0))
                   / (SUM(w) OVER () - COALESCE(SUM(w) OVER before, 0))::DOUBLE AS share
         FROM src WINDOW before AS (ORDER BY 3 * z / w::DOUBLE, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, z, LEAST(3 * z, MAX(share) OVER () * w)::DOUBLE AS target FROM fill),
lev AS (SELECT source, level, SUM(size) AS words FROM leveled WHERE level > 0 GROUP BY ALL),
fac AS (SELECT l.*, t.target, (t.target - COALESCE(SUM(3 * words) OVER above, 0))
               / (SUM(level * words) OVER (PARTITION BY l.source) - COALESCE(SUM(level * words) OVER above, 0)) AS f
        FROM lev l JOIN tgt t ON t.source IS NOT DISTINCT FROM l.source
        WINDOW above AS (PARTITION BY l.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cop AS (SELECT *, LEAST(3, MAX(f) OVER (PARTITION BY source) * level) AS m FROM fac),
pl AS (SELECT *, floor(m + 1e-9) AS whole, GREATEST(m - floor(m + 1e-9), 0) AS p FROM cop),
plan AS (SELECT *, target - SUM(whole * words) OVER (PARTITION BY source) AS missing FROM pl),
drawn AS (SELECT d.doc_id, d.source, d.size, missing, (u / (1 - u)) / (p / (1 - p)) AS q
          FROM leveled d JOIN plan ON plan.source IS NOT DISTINCT FROM d.source AND plan.level = d.level WHERE p > 0),
along AS (  -- along the order: first what fits, then round by round those of at most half the gap left
  SELECT doc_id, source, size, q, missing::DOUBLE AS gap, 0 AS round, size <= missing AND
         SUM(CASE WHEN size <= missing THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING)
           <= missing AS hit FROM drawn
  UNION ALL
  SELECT doc_id, source, size, q, left_gap, round + 1, 2 * size <= left_gap AND
         SUM(CASE WHEN 2 * size <= left_gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING)
           <= left_gap
  FROM (SELECT *, gap - SUM(CASE WHEN hit THEN size ELSE 0 END) OVER (PARTITION BY source) AS left_gap,
               bool_or(hit) OVER (PARTITION BY source) AS went FROM along)
  WHERE NOT hit AND (round = 0 OR went)),
spare AS (SELECT d.doc_id, d.source, d.size, d.q,
                 d.missing - SUM(CASE WHEN t.doc_id IS NULL THEN 0 ELSE d.size END) OVER (PARTITION BY d.source) AS gap, t.doc_id IS NULL AS free
          FROM drawn d LEFT JOIN (SELECT doc_id FROM along WHERE hit) t ON t.doc_id = d.doc_id),
closing AS (  -- then the one nearest in size to the gap, while that comes nearer to the target
  SELECT doc_id, source, size, q, gap, abs(size - gap) < gap AND row_number() OVER (
           PARTITION BY source, abs(size - gap) < gap ORDER BY abs(size - gap), q, doc_id) = 1 AS hit FROM spare WHERE free
  UNION ALL
  SELECT doc_id, source, size, q, left_gap, abs(size - left_gap) < left_gap AND row_number() OVER (
           PARTITION BY source, abs(size - left_gap) < left_gap ORDER BY abs(size - left_gap), q, doc_id) = 1
  FROM (SELECT *, gap - SUM(CASE WHEN hit THEN size ELSE 0 END) OVER (PARTITION BY source) AS left_gap,
               bool_or(hit) OVER (PARTITION BY source) AS went FROM closing)
  WHERE NOT hit AND went),
more AS (SELECT doc_id FROM along WHERE hit UNION ALL SELECT doc_id FROM closing WHERE hit)
SELECT d.doc_id, d.source, d.size, CAST(tgt.z AS BIGINT) AS source_size, tgt.target,
       CAST(COALESCE(whole, 0) + (d.doc_id IN (FROM more))::INT AS BIGINT) AS copies,
       CAST((COALESCE(whole, 0) + (d.doc_id IN (FROM more))::INT) * d.size AS BIGINT) AS taken
FROM leveled d JOIN tgt ON tgt.source IS NOT DISTINCT FROM d.source
LEFT JOIN plan ON plan.source IS NOT DISTINCT FROM d.source AND plan.level = d.level
""",
}

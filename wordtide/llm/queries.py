"""Registered queries of the operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm import alignment, chat, collocations, minhash, nndescent, packing, pieces, quality, secrets, simhash, toxicity, voronoi, warc
from wordtide.llm.tables import table


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


#: A conversation whose texts hold the template's own control strings.
CONTROL_CASE = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a record of its own, in one of three layouts with a row per turn, by a hash."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    case = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)],
        "conv_id long, turn long, role string, text string",
    )
    conv, text = F.col("conv_id"), F.coalesce("text", F.lit(""))
    message = F.struct("role", text.alias("content"))
    parts = F.struct("role", F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    layouts = (
        F.struct(conv.alias("conv"), "turn", "role", text.alias("text")),
        F.struct(conv.alias("conversation"), F.col("turn").alias("index"), message.alias("message")),
        F.struct(conv.alias("conversation"), F.col("turn").alias("index"), parts.alias("message"), F.lit("n").alias("source")),
    )
    records = [F.to_json(fields, {"ignoreNullFields": "false"}) for fields in layouts]
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(records)))
    record = F.when(kind == 0, records[0]).when(kind == 1, records[1]).otherwise(records[2])
    return chat.format_chats(rows.unionByName(case).select("conv_id", record.alias("record")))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'))
    + length(role) + 6 + 8 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


TOP_SCALE = 256
TOP_K = 5


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = voronoi.scaled(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", TOP_SCALE)
    return voronoi.top_k(data, data.where("id % 50 = 0"), TOP_K).select(
        "query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score")
    )


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.y, d.y) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.roundtrip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.flagged(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnsRenamed(
        {"vec_id": "id", "embedding": "vector"}
    )
    found = nndescent.search(data, data.where("id % 20 = 0"), 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS k FROM p),
total AS (SELECT lang, CAST(sum(len(k)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest([array_to_string(k[i:i + m - 1], ' ') FOR i IN range(1, len(k) - m + 2)]) AS phrase
    FROM w, (VALUES (1), (2), (3), (4), (5)) AS lengths(m) WHERE len(k) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, string_split(c.phrase, ' ') AS x
  FROM f c, (VALUES (1), (2), (3), (4)) AS cut(k) WHERE k < c.m),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, k,
    CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN total USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[k + 1:], ' ')),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM f c WHERE c.lang = s.lang AND c.m > len(string_split(s.phrase, ' ')) AND 100 * c.f >= 100 * s.a
      AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000"""


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op11_simhash": op11_simhash, "op12_collocations": op12_collocations, "op13_alignment": op13_alignment, "op6_neighbours": op6_neighbours, "op2_toxicity": op2_toxicity, "op4_quality": op4_quality, "op1_minhash": op1_minhash, "op7_sentencepiece": op7_sentencepiece, "op3_secrets": op3_secrets, "op9_packing": op9_packing, "op5_exact_top_k": op5_exact_top_k, "op10_warc": op10_warc, "op8_chat": op8_chat}
ORACLES = {"op12_collocations": OP12_SQL, "op5_exact_top_k": OP5_SQL, "op10_warc": OP10_SQL, "op8_chat": OP8_SQL}

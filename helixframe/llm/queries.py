"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, jaccard, mixing, packing, quality, sharding, simhash, tokens, topk, urls, vcodes, warc
from .common import table

TOKENIZER = "piece_bpe_32k.model"
SHARDS = 40
#: Weights of the shards and of the one that is added: 1, 1.5 and 2 in turn, as of hosts of three sizes.
WEIGHTS = [1.0 + 0.5 * (s % 3) for s in range(SHARDS + 1)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS)


def op2_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    used = mixing.usage(docs, mixing.MixParams())
    return used.select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "cut_tokens")


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, WEIGHTS[:SHARDS], WEIGHTS)


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.component_ids(docs, 75, 100, 5).select("doc_id", "n_shingles", "component_id")


def op6_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    turn = lambda i, role: F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(turn(0, "user"), turn(1, "assistant"))).alias("t"))
    extra = extra.select("conv_id", "t.turn", "t.role", said.alias("text"))
    return chat.digest(chat.in_layouts(chat.nest(rows.unionByName(extra))), chat.CANONICAL_ROLES)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcodes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mcd_quality, op2_hierarchical_mix, op3_rendezvous_shards, op4_length_buckets, op5_ngram_jaccard, op6_bpe_counts, op7_topk_search, op8_url_filter, op9_chat_format, op10_warc_round_trip, op11_simhash_pivots, op12_filter_audit, op13_vector_codes)}

_CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), shown AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS t,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS r
  FROM clean
), conv AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         string_agg('### ' || r || ': ' || t || '</turn>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS formatted
  FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       length(formatted) AS formatted_chars
FROM conv
"""

_TOPK_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, b.y FROM reach r JOIN sym b ON r.other = b.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""

_WARC_SQL = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM rows),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][CAST(instr('0123456789abcdef', substr(h, CAST(i AS INT), 1)) AS INT)]), '') AS b
  FROM hashed
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(b, CAST(5 * j + 1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * j + 2 AS INT), 1) AS INT) + 4 * CAST(substr(b, CAST(5 * j + 3 AS INT), 1) AS INT)
    + 2 * CAST(substr(b, CAST(5 * j + 4 AS INT), 1) AS INT) + CAST(substr(b, CAST(5 * j + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""

_AUDIT_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), judged AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM base
), flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM judged LEFT JOIN flags USING (doc_id)
), kinds AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [v.i, w.i, x.i, y.i, z.i] AS o FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5
), steps AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i AS INT), 1)), '') AS filter_order, CAST(i AS INT) AS step FROM orders, letters),
placed AS (
  SELECT part, filter_order, step, o[step] AS f, fails, n, good, toxic,
         list_position(list_transform(o, lambda i: fails[i]), true) AS leaves
  FROM kinds, steps
), summed AS (
  SELECT part, filter_order, step, any_value(f) AS f, sum(CASE WHEN leaves IS NULL OR leaves > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN leaves = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails[f] AND leaves < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN leaves = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN leaves = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """All rounds one after another, every distance computed."""
    ctes = [f"""
rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
parts AS MATERIALIZED (SELECT r, i, list_slice(v, CAST(i * (len(v) // {parts}) + 1 AS INT), CAST((i + 1) * (len(v) // {parts}) AS INT)) AS x FROM rows, (SELECT unnest(range(0, {parts})) AS i))""", f"""
b0 AS MATERIALIZED (SELECT i, e, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM rows QUALIFY e < {entries}) USING (r))"""]
    near = lambda book: f"SELECT r, p.i, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT), e := e)) AS m FROM parts p JOIN {book} b ON p.i = b.i GROUP BY r, p.i"
    for n in range(rounds):
        ctes.append(f"""
a{n} AS MATERIALIZED ({near(f'b{n}')}),
u{n} AS (SELECT i, m.e AS e, unnest(x) AS y, unnest(range(0, len(x))) AS pos FROM parts JOIN a{n} USING (r, i)),
m{n} AS (SELECT i, e, list(y ORDER BY pos) AS c FROM (SELECT i, e, pos, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM u{n} GROUP BY i, e, pos) GROUP BY i, e),
b{n + 1} AS MATERIALIZED (SELECT o.i, o.e, coalesce(m.c, o.c) AS c FROM b{n} o LEFT JOIN m{n} m ON o.i = m.i AND o.e = m.e)""")
    return "WITH " + ",".join(ctes) + f""",
last AS MATERIALIZED ({near(f'b{rounds}')}),
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY i) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM last GROUP BY r),
hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY i, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows JOIN coded USING (r), hash
"""


ORACLE = {"op12_filter_audit": _AUDIT_SQL, "op13_vector_codes": _codes_sql(), "op5_ngram_jaccard": _JACCARD_SQL, "op10_warc_round_trip": _WARC_SQL, "op7_topk_search": _TOPK_SQL, "op9_chat_format": _CHAT_SQL}

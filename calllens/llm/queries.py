"""One registered query per operator, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens.llm import (
    align, decontam, exact_dedup, langid, licenses, line_dedup, mixing, sharding, simhash, spelling, toxicity, warc, wavelet,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The tokenizer of the token-id queries and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


BITS = "CAST(CAST(from_hex(sha1(body)) AS BIT) AS VARCHAR)"
BASE32_SQL = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + "
    + " + ".join(f"{16 >> k} * CAST(substr({BITS}, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INT)" for k in range(5))
    + " AS BIGINT), 1)), '')"
)


@query(
    "op1_warc",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, {BASE32_SQL} AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CAST(CASE WHEN page_id < top THEN top END AS BIGINT) AS refers_to, true AS valid FROM r""",
)
def _(spark, sf):
    records = warc.archive(table(spark, sf, "pages"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.isnull("problem").alias("valid")
    )


@query(
    "op2_exact_dedup",
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm""",
)
def _(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


WORDS_SQL = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op4_decontamination",
    f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
m AS (SELECT DISTINCT doc_id, item_id, k, i FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def _(spark, sf):
    found = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_token_ids")
def _(spark, sf):
    tokens = wavelet.token_table(table(spark, sf, "documents"), tokenizer_path(), end_id=END_ID)
    return tokens.withColumnRenamed("id", "doc_id")


@query("op10_simhash")
def _(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op3_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"),
        toxicity.is_held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits",
    )


@query("op9_language_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return langid.identify(docs, langid.train(docs)).select(
        F.col("id").alias("doc_id"), langid.is_held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )


@query("op6_licenses")
def _(spark, sf):
    return licenses.digest(licenses.scan(table(spark, sf, "documents"))).withColumnRenamed("id", "doc_id")


@query("op7_mixing")
def _(spark, sf):
    rows, _ = mixing.mix(table(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


@query("op8_line_dedup")
def _(spark, sf):
    lines = line_dedup.line_classes(table(spark, sf, "documents"))
    return lines.select(F.col("id").alias("doc_id"), "line_no", "class_id", "class_line", "links", "kept")


#: CRC-32 of a list of byte values ``bytes``, with the table ``t`` of its 256 remainders.
CRC_TABLE_SQL = (
    "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), "
    "lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i))"
)
CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda s, x: xor(s >> 8, t[1 + (xor(s, x) & 255)])))"


def bytes_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


SHARDS = 24


@query(
    "op12_sharding",
    f"""WITH RECURSIVE c AS ({CRC_TABLE_SQL}),
w AS (SELECT DISTINCT doc_id, CAST(doc_id AS HUGEINT) AS key, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS far FROM documents
  UNION ALL SELECT doc_id, k, far, CAST(floor((far + 1) * (2147483648.0::DOUBLE / CAST((k >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, far, (key * {sharding.MULTIPLIER} + 1) % 18446744073709551616 AS k FROM w WHERE far < {SHARDS})),
p AS (SELECT doc_id, place, far FROM w WHERE far >= {SHARDS}),
d AS (SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, {CRC_SQL} AS text_crc32
  FROM (SELECT doc_id, text, {bytes_sql("text")} AS bytes FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(place AS INT) AS shard,
  row_number() OVER (PARTITION BY place ORDER BY doc_id, size, text_crc32) - 1 AS slot,
  CAST(CASE WHEN far = {SHARDS} THEN far ELSE place END AS INT) AS grown_shard FROM d JOIN p USING (doc_id)""",
)
def _(spark, sf):
    placed = sharding.assign(table(spark, sf, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query(
    "op11_spelling_variants",
    f"""WITH RECURSIVE c AS ({CRC_TABLE_SQL}),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {CRC_SQL} AS h FROM (SELECT run, n, {bytes_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS bytes
  FROM r WHERE length(run) >= 7), c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 > 0 THEN run
  ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other FROM x a JOIN x b USING (i, d) WHERE a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.d = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.d = v.word),
f AS (SELECT p.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS best, max(v.n) AS best_n FROM p JOIN v ON p.other = v.word GROUP BY p.word),
w AS (SELECT word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN f USING (word)),
t AS (SELECT word, word AS stop, form AS ahead FROM w UNION ALL SELECT t.word, w.word, w.form FROM t JOIN w ON t.ahead = w.word)
SELECT word, form, stop AS root, n, n_near, form_n FROM w JOIN t USING (word) WHERE t.ahead IS NULL""",
)
def _(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query("op13_token_alignment")
def _(spark, sf):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return align.alignment(table(spark, sf, "documents"), *paths).withColumnRenamed("id", "doc_id")

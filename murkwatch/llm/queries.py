"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, exact, minhash, packing, pii, quality, recompress, rindex, sharding, token_counts, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Stands for a secret that a deployment would read from its own store.
PII_KEY = "pseudonyms"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), PIECES)


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), TOKENIZER, RANKS, public_tokenizers.PATTERN,
                          digest={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, folder, "documents"), texts=False).drop("kept_text")


@query
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ids = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.groups(table(spark, folder, "documents"))


ORACLES["op8_exact_dedup"] = r"""
SELECT doc_id, MIN(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
       ROW_NUMBER() OVER (PARTITION BY content ORDER BY doc_id) = 1 AS kept, sha256(content) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
WINDOW same AS (PARTITION BY content)
"""


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"))


ORACLES["op2_quality_rules"] = r"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         regexp_split_to_array(text, '\n') AS lines
  FROM texts),
grams AS (
  SELECT doc_id, place, gram, COUNT(*) OVER (PARTITION BY doc_id, gram) AS times
  FROM (SELECT doc_id, place, array_to_string(words[place:place + 4], ' ') AS gram
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS place FROM split WHERE len(words) >= 5))),
repeats AS (
  SELECT doc_id, COUNT(DISTINCT word_place) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(place, place + 5)) AS word_place FROM grams WHERE times > 1) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(text) AS n_chars
  FROM split LEFT JOIN repeats USING (doc_id)),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         least(1000 * n_symbols // greatest(n_chars, 1), 1000) AS symbols, least(1000 * n_dup_lines // n_lines, 1000) AS dup_lines,
         least(1000 * n_repeat_words // greatest(n_words, 1), 1000) AS repeats, least(10 * word_chars // greatest(n_words, 1), 1000) AS word_length
  FROM counts),
long AS (
  UNPIVOT (SELECT doc_id, lang, source, symbols, dup_lines, repeats, word_length FROM measured WHERE NOT base_failed)
  ON symbols, dup_lines, repeats, word_length INTO NAME measure VALUE v),
own AS (
  SELECT lang, source, measure, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL),
wide AS (SELECT lang, measure, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL),
spread AS (SELECT * FROM (VALUES ('symbols', 20, 0), ('dup_lines', 100, 0), ('repeats', 45, 0), ('word_length', 5, 10)) t (measure, least_spread, least_value)),
fences AS (
  SELECT own.lang, own.source, measure,
         least(greatest(own.q1 - 3 * greatest(own.q3 - own.q1, least_spread), CAST(ceil((own.q1 + least_value) / 2) AS BIGINT)),
               greatest(wide.q1 - 3 * greatest(wide.q3 - wide.q1, least_spread), CAST(ceil((wide.q1 + least_value) / 2) AS BIGINT))) AS low,
         greatest(least(own.q3 + 3 * greatest(own.q3 - own.q1, least_spread), (own.q3 + 1000) // 2),
                  least(wide.q3 + 3 * greatest(wide.q3 - wide.q1, least_spread), (wide.q3 + 1000) // 2)) AS high
  FROM own JOIN spread USING (measure) JOIN wide USING (measure) WHERE own.lang IS NOT DISTINCT FROM wide.lang),
refused AS (
  SELECT DISTINCT doc_id FROM long JOIN fences USING (measure)
  WHERE long.lang IS NOT DISTINCT FROM fences.lang AND long.source IS NOT DISTINCT FROM fences.source
    AND (v > high OR measure = 'word_length' AND v < low))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM refused) AS kept
FROM measured
"""


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = chat.read_back(chat.windows(own.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.pseudonymise(docs.select("doc_id", "text"), PII_KEY)


@query
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.components(table(spark, folder, "documents"), size=3, percent=85)


@query
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rindex.remove_earlier(table(spark, folder, "documents")).drop("kept")


@query
def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"))


def _clustering_sql(rounds: int = 3) -> str:
    """The seeds, ``rounds`` pairs of assignment and means, and the last assignment."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT kept.r, any_value(vec_id) AS vec_id, any_value(kept.v) AS v,
         min(struct_pack(d := CAST(list_sum(list_transform(range(1, 65), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i]))) AS BIGINT), c := c{r}.c)) AS best
  FROM kept CROSS JOIN c{r} GROUP BY kept.r)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(means.v, c{r}.v) AS v
  FROM c{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t (i) GROUP BY best.c, i) GROUP BY c) means ON means.c = c{r}.c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept QUALIFY c < 16),{",".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c
"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shuffled(table(spark, folder, "documents").select("doc_id", "text"))
    return placed.select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(table(spark, folder, "conversations"))


ORACLES["op13_conversation_trie"] = """
WITH RECURSIVE turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, max(place) AS own,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM turns GROUP BY c),
lent AS (SELECT convs.*, least(h, coalesce(b.own, 0)) AS shared FROM convs LEFT JOIN (SELECT c AS base, own FROM convs) b USING (base)),
rebuilt AS (
  SELECT lent.c, place AS depth, role, text FROM lent JOIN turns ON turns.c = base WHERE place <= shared
  UNION ALL
  SELECT lent.c, place - h + shared, role, text FROM lent JOIN turns ON turns.c = lent.c WHERE place > h),
paths AS (
  SELECT c, depth, strlen(text) AS bytes, list(md5(role) || md5(text)) OVER (PARTITION BY c ORDER BY depth) AS path FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM ended GROUP BY path),
kids AS (
  SELECT nodes.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = nodes.depth + 1 AND k.path[:len(k.path) - 1] = nodes.path) AS n_children
  FROM nodes LEFT JOIN nodes p ON nodes.depth = p.depth + 1 AND p.path = nodes.path[:len(nodes.path) - 1]),
below AS (
  SELECT top.path, count(*) FILTER (WHERE low.n_children = 0) AS n_leaves, sum((low.n_convs - 1) * low.bytes) AS saved_tokens
  FROM kids top JOIN kids low ON low.depth >= top.depth AND low.path[:len(top.path)] = top.path GROUP BY top.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM kids JOIN below USING (path)
"""

"""The operators applied to whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compaction import compacted
from .decontam import contaminated
from .neardup import near_duplicates
from .outliers import quality_verdicts
from .packing import dialogue_examples, pack_documents, pack_examples
from .perspectives import perspectives
from .suffixdedup import suffix_dedup
from .tokenfile import token_digest
from .toxicity import toxicity_scores
from .warc import archived_pages

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).drop("url")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    # Rows come from files that the manifest names, in tiers that no merge is due for.
    committed, settled = F.col("shard").isNotNull(), F.coalesce(F.col("tier_shards") < 4, F.lit(False))
    return compacted(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"), committed.alias("committed"), settled.alias("settled"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return out.select("conv_id", "participant", "first_turn", "n_turns", F.md5("rendered").alias("rendered_md5"), F.length("rendered").cast("long").alias("n_chars"), spans.alias("mask_spans"), "n_masked")


def packed_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector packing of instruction data: each participant's view of a dialogue is an example, of which
    only that participant's turns bear loss; sequences of 4096 tokens, 16 examples and 1536 of loss."""
    examples = dialogue_examples(perspectives(table(spark, sf_dir, "conversations")), TOKENIZER)
    return pack_examples(examples, 4096, 16, 1536, ("conv_id", "participant", "first_turn", "n_tokens", "n_loss"), "alone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_warc, op3_quality, op4_decontamination, op5_packing, op6_sharding, op7_near_duplicates, op8_suffix_dedup, op9_token_records, op10_perspectives, packed_dialogues)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
     si AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
     n AS (SELECT item_id, count(*) AS n_item_shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared
FROM ds JOIN si USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING count(*) >= ceil(0.8 * n_item_shingles)""",
    # Base32 by five hex digits at a time: twenty bits, four letters.
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(page_id, -9223372036854775808) AS k FROM pages),
     d AS (SELECT *, sha1(h) AS x, min(k) OVER (PARTITION BY sha1(h), strlen(h)) AS first FROM p),
     r AS (SELECT *, page_id IS NOT NULL AND first <> k AS revisit,
                  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> b) % 32 AS INTEGER), 1)), '')), '') AS own FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, own AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit AND first <> -9223372036854775808 THEN first END AS refers_to FROM r""",
    "op6_sharding": "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5, TRUE AS committed, TRUE AS settled FROM documents",
    "op7_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS s FROM w),
     t AS (SELECT doc_id, unnest(s) AS x FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
     y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT y.b, r.c FROM r JOIN y ON y.a = r.doc_id),
     m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept FROM s JOIN m USING (doc_id)""",
    # Windows of 100 bytes as hex digits, a piece of 500 windows at a time: all but the first of equal ones go.
    "op8_suffix_dedup": """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     c AS (SELECT r, length(h) // 2 - 99 AS n, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT), 500)) AS base, h FROM d),
     u AS (SELECT r, n, base, substr(h, CAST(2 * base + 1 AS BIGINT), 1198) AS piece FROM c),
     w AS (SELECT r, base, unnest(range(0, CAST(least(500, n - base) AS BIGINT))) AS k, piece FROM u),
     e AS (SELECT r << 32 | (base + k) AS place, md5_number(substr(piece, CAST(2 * k + 1 AS BIGINT), 200)) AS m FROM w),
     f AS (SELECT place >> 32 AS r, place & 4294967295 AS i FROM e WHERE place NOT IN (SELECT min(place) FROM e GROUP BY m)),
     g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM f),
     n AS (SELECT r, i, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
     s AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY r, span),
     q AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM s),
     x AS (SELECT q.r, sum(b - a) AS gone, count(*) AS spans, max(b) AS tail, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS kept FROM q JOIN d ON d.r = q.r GROUP BY q.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN x USING (r)""",
    "op10_perspectives": r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
     p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS place FROM t),
     x AS (SELECT n.conv_id, participant, place - place % 1024 AS first_turn, place, role = participant AS own,
                  CASE WHEN role = participant THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
                       ELSE '<|im_start|>user name=' || replace(regexp_replace(role, '\s', '_', 'g'), '<|', '< |') || chr(10) END AS head,
                  text || '<|im_end|>' AS body
           FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
     z AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, first_turn ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM x)
SELECT conv_id, participant, first_turn, count(*) AS n_turns, md5(string_agg(head || body || chr(10), '' ORDER BY place)) AS rendered_md5,
       CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars,
       coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(a + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE own), '') AS mask_spans,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM z GROUP BY conv_id, participant, first_turn""",
}

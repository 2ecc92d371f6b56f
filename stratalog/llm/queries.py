"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality, toxicity
from .chat import digests, format_conversations, reply_chains
from .common import documents, table
from .decontamination import find_contaminated
from .exact_dedup import mark_exact_duplicates
from .html import extract
from .packing import pack_documents
from .passages import repeated_passages
from .simhash import near_components
from .sstable import tokenised_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised_table(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(reply_chains(rows.unionByName(extra))))


def op7_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination,
        op2_toxicity,
        op3_sstable_tokens,
        op4_quality_attention,
        op5_best_fit_packing,
        op6_reply_trees,
        op7_html_tree_scoring,
        op8_exact_dedup,
        op9_simhash_near_dedup,
        op10_compact_windows,
    )
    return {f.__name__: f for f in found}


_EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


_DECONTAMINATION = r"""
WITH bw AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM bw WHERE w <> [''])
), bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
dw AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE w <> [''])
)
SELECT doc_id, item_id, n AS item_shingles, count(*) AS matched, count(*) / n AS containment
FROM ds JOIN bs USING (s) JOIN bn USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(n * 0.8 - 1e-9)
"""


#: Each turn is "### ", role, ": ", text, " </turn>" and a line end: 15 characters beside role and text. An escape adds one to
#: each backslash, to each "#" before "##" and to each "<" before "/turn>" of a text, and to each of \ # < : and line end of a role.
_REPLY_TREES = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         15 + length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
         + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0) + len(regexp_extract_all(text, '</turn>')) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _DECONTAMINATION, "op6_reply_trees": _REPLY_TREES, "op8_exact_dedup": _EXACT_DEDUP}

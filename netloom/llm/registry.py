"""Queries over the given tables that apply each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe_matrix, chat, common, content_sort, decontaminate, html_text, language, packing, prefix_trie, pseudonyms, sharding, simhash, token_cache, whitening
from netloom.session import run_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the folder is installed alike on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=2048)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"), radius=3, width=3, seed=42)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark"), width=10).drop("spans")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(common.table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key="netloom-demonstration-key")


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.duplicate_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    found = chat.windows(conversations.union(extra), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), budget=1024, history=2)
    return chat.read_back(found)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_cache.token_counts(docs, run_dir(spark, "token-counts"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), limit=1024)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16, scale=64.0, origin=1_000_000)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    found = bpe_matrix.encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    back = bpe_matrix.decode(found, ranks)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), family=20, heads=4)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_html": op5_html,
    "op6_sharding": op6_sharding,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_content_sort": op8_content_sort,
    "op9_chat": op9_chat,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

# Words of both tables in order; windows of 10 words as text, with the place they start at.
_WINDOWS = rf"""
    dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
    ii AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM iw WHERE len(w) > 0),
    phrases AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS phrase FROM ii),
    sizes AS (SELECT DISTINCT n FROM phrases),
    di AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
    dp AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase FROM di, sizes WHERE p + n - 1 <= len(w)),
    found AS (SELECT DISTINCT doc_id, p, n, item_id FROM dp JOIN phrases USING (n, phrase)),
    hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)"""

SQL = {
    "op4_decontamination": f"""
        WITH {_WINDOWS}
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_content_sort": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents),
             g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(norm) AS text_sha256 FROM g""",
}

"""The registered queries of this subpackage: each operator over its whole table, with its contract's columns."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, embedding_dedup, licenses, line_dedup, maxent_lm, merkle, secrets_scan, simhash,
               token_rollup, toxicity, warc, whitening)
from .common import lower_ascii, new_path, read, stored

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _history(spark: SparkSession, docs: DataFrame, versions: list[str]) -> token_rollup.Rollup:
    """A rollup of ``docs`` (source, lang, estimate and a count per version) after a history of batches: estimates of
    the first version are inserted in four batches, one of them sent twice, and revised to its counts; the other versions
    are inserted; documents of fewer than 20 tokens are deleted for all versions and inserted again."""
    first, *others = versions
    kinds = dict(zip([*token_rollup.KEYS, "n_tokens"], ["string", "string", "string", "long"]))

    def state(prefix: str, tokenizer: str, n: str) -> list:
        return [F.col("source").alias(prefix + "source"), F.col("lang").alias(prefix + "lang"),
                F.lit(tokenizer).alias(prefix + "tokenizer"), F.col(f"`{n}`").alias(prefix + "n_tokens")]

    def no_state(prefix: str) -> list:
        return [F.lit(None).cast(t).alias(prefix + k) for k, t in kinds.items()]

    def change(df: DataFrame, op: str, new: list, old: list) -> DataFrame:
        return df.select(F.lit(op).alias("op"), *new, *old)

    def all_versions(df: DataFrame, op: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [change(df, op, *(
            (no_state(""), state("old_", v, v)) if op == "delete" else (state("", v, v), no_state("old_")))) for v in versions])

    short = docs.where(F.col(f"`{first}`") < 20)
    quarter = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.lit(0))
    batches = {f"insert-{k}": change(docs.where(quarter == k), "insert", state("", first, "estimate"), no_state("old_")) for k in range(4)}
    batches["revise"] = change(docs.where(F.col("estimate") != F.col(f"`{first}`")), "revise", state("", first, first),
                               state("old_", first, "estimate"))
    batches |= {f"version-{v}": change(docs, "insert", state("", v, v), no_state("old_")) for v in others}
    batches |= {"delete": all_versions(short, "delete"), "restore": all_versions(short, "insert")}
    store = token_rollup.Rollup(spark, new_path(spark, "token-rollup"))
    for name in ["insert-0", "insert-1", "insert-2", "insert-1", "insert-3", "revise", *(f"version-{v}" for v in others)]:
        store.commit(name, batches[name])
    store.compact()
    for name in ["delete", "revise", "restore"]:
        store.commit(name, batches[name])
    return store


ESTIMATE = "ceil(coalesce(n_chars, 0) / 6) AS estimate"  # tokens, before a text is read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all ``documents`` by source, language and tokenizer version, after the batches of ``_history``:
    blank-separated words, and the bytes that byte-level models read. ``token_counts_bpe`` counts by a vocabulary."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs, _ = stored(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars").select(
        "doc_id", "lang", "source", F.expr(ESTIMATE), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words-1"),
        F.octet_length(text).alias("bytes-1")), "token-counts")
    return _history(spark, docs, ["words-1", "bytes-1"]).totals()


ORACLE_OP1 = r"""
WITH c AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  strlen(coalesce(text, '')) AS bytes FROM documents),
s AS (SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM c UNION ALL SELECT source, lang, 'bytes-1', bytes FROM c)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM s GROUP BY ALL
"""


def token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all ``documents`` by the byte-level BPE of a public vocabulary, after the batches of ``_history``."""
    docs, _ = stored(bpe.encode(
        read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
        .select(F.struct("doc_id", "lang", "source", F.expr(ESTIMATE)).alias("row"), "text"), bpe.read_vocabulary(VOCABULARY),
        public_tokenizers.PATTERN, "row").select("id.*", F.size("ids").alias("bpe-50k-1")), "token-counts-bpe")
    return _history(spark, docs, ["bpe-50k-1"]).totals()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back, as digests."""
    return bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), bpe.read_vocabulary(VOCABULARY),
                          public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text; labels of held-out rows are never read."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted", "n_restored")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisit records made from ``pages``, resolved; response_id is -1 where there is none."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.resolve_revisits(warc.page_records(pages)).withColumn(
        "response_id", F.coalesce("response_id", F.lit(-1))).withColumn(
        "headers", F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at cosine 0.93."""
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows, as digests."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
                      F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, grouped at two differing bits."""
    got = simhash.simhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, max_bits=2)
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every text."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document, and where (in tokens)."""
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.find_overlaps(docs, items).select(
        "doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("item_ids"),
        F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["item"], s["start"], s["end"])), ",").alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secrets_scan.digests(secrets_scan.find_secrets(read(spark, sf_dir, "documents", "doc_id", "text")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened along the eight leading principal components, a row per vector and component.

    ``deviation`` is null where it doesn't fit a long; ``deviation_exact`` has its digits then."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=8)
    fits = F.col("deviation") <= F.lit(2 ** 63 - 1)
    return out.select(
        F.col("id").alias("vec_id"), "n", F.when(fits, F.col("deviation")).cast("long").alias("deviation"),
        F.when(~fits, F.col("deviation").cast("string")).alias("deviation_exact"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error", "deviation_exact")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents`` by source, and whether each row still leads to the root after
    the texts of every fifth id (by CRC-32) were lower-cased."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")

    def leaf(text):
        return merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)

    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(lower_ascii(F.col("text")))).alias("altered"))
    out = merkle.manifest(leaves, group="source", order="doc_id", digest="leaf")
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("witness"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under a maximum-entropy model and a unigram base, learnt without the held-out rows."""
    out_of_training = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    out = maxent_lm.score(read(spark, sf_dir, "documents", "doc_id", "text"), ~out_of_training)
    return out.select(F.col("id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


QUERIES = {f.__name__: f for f in (
    op1_token_counts, token_counts_bpe, op2_bpe, op3_toxicity, op4_warc_revisits, op5_embedding_dedup, op6_line_dedup,
    op7_simhash_dedup, op8_license_scan, op9_decontaminate, op10_secret_scan, op11_whitening,
    op12_merkle_manifest, op13_lm_score)}

ORACLE = {"op1_token_counts": ORACLE_OP1, "op4_warc_revisits": warc.ORACLE, "op6_line_dedup": line_dedup.ORACLE,
          "op12_merkle_manifest": merkle.ORACLE}

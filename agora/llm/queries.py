"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.runtime import read_table, undone

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.line_dedup import dedup

    found = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), bound=1)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.sentencepieces import decode, segment

    model = vocabulary_path("piece_bpe_32k.model")
    found = segment(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model, n=3)
    best = F.col("nbest")[0]["ids"]
    digests = found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"),
        F.floor(F.octet_length(best) / 4).cast("long").alias("n_pieces"),
        F.col("nbest.score").alias("scores"),
        F.transform("nbest", lambda x: F.crc32(x["ids"])).alias("ids_crc32"),
        best.alias("ids"),
    )
    back = F.sha2("decoded", 256) == F.col("row.text_sha256")
    return decode(digests, model).select("row.doc_id", "row.n_pieces", "row.scores", "row.ids_crc32", back.alias("round_trip"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.quality_rules import fit, judge

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.substring_dedup import dedup

    found = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.embedding_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.runtime import remove
    from agora.llm.warc import archive, deduplicate, records

    raw = archive(read_table(spark, sf_dir, "pages"))
    resolved = deduplicate(spark, raw)
    found = records(spark, resolved)
    remove(spark, raw, resolved)
    return found


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.filter_audit import audit

    return audit(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.lm_scoring import fit, held_out, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agora.llm.merkle import fold, hex_of, leaf_digest, manifest, proof_digest

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest("doc_id", "source", "lang", "n_chars", lower))
    leaf = leaf_digest("doc_id", "source", "lang", "n_chars", "text")
    found = manifest(docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("order"), leaf.alias("node"), F.struct("doc_id", tampered.alias("tampered")).alias("row")))
    root = hex_of("root")
    folded = fold(F.coalesce("row.tampered", "node"), F.col("path"))
    return found.select("row.doc_id", hex_of("node").alias("leaf"), hex_of("subroot").alias("subroot"), root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))


def guarded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which leaves no table in the shared folder if it fails."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with undone(spark):
            return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: guarded(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from agora.llm.sql import ORACLE

    return {name: text.strip() for name, text in ORACLE.items()}

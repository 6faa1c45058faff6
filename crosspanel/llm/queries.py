"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosspanel.llm import jaccard, langid, licences, pieces, pii, quality, repair, repeats, secrets, shards, trie, warc, winnow
from crosspanel.llm.frames import read_input

VOCABULARY_KEY = "spark.crosspanel.vocabulary"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PII_KEY = "spark.crosspanel.pii.key"
#: Key of the registered query; production sets ``PII_KEY`` to a secret.
DEMO_KEY = "not a secret: set spark.crosspanel.pii.key"


def vocabulary(spark: SparkSession) -> pieces.Vocabulary:
    """The vocabulary file named in the session; its merge ranks become Zipf scores."""
    return pieces.load_vocabulary(spark.conf.get(VOCABULARY_KEY, VOCABULARY), "zipf")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, DEMO_KEY).encode()[:64]
    out = pii.pseudonymise(read_input(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_checked(read_input(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(spark))
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "round_trip")


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read_input(spark, sf_dir, "documents"))


def op4_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_input(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.fit(docs))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(winnow.decontaminate(read_input(spark, sf_dir, "documents"), read_input(spark, sf_dir, "benchmark")))


def op6_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, read_input(spark, sf_dir, "pages"))


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(read_input(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_input(spark, sf_dir, "documents"))


def op9_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(read_input(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_input(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.span_digests(secrets.find_secrets(docs, secrets.fit(docs)).drop("text"))


def op11_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.build_shards(read_input(spark, sf_dir, "documents"))


def op12_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(read_input(spark, sf_dir, "conversations")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damaged(read_input(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_feistel_pseudonyms, op2_sentencepiece, op3_adaptive_quality, op4_licence_classifier, op5_winnowing, op6_warc_source, op7_string_kernel, op8_parity_sketch_join, op9_radix_repeats, op10_secret_grammar, op11_two_pass_shuffle, op12_zfast_trie, op13_conversation_repair)
}
ORACLES: dict[str, str] = {
    "op3_adaptive_quality": quality.ORACLE,
    "op5_winnowing": winnow.ORACLE,
    "op6_warc_source": warc.ORACLE,
    "op8_parity_sketch_join": jaccard.ORACLE,
    "op11_two_pass_shuffle": shards.ORACLE,
    "op12_zfast_trie": trie.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}

"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, codes, common, decontaminate, licenses, mixing, pii, ppm, pseudo, quality, simhash, suffix, trie, weak
from .oracles import ORACLE_SQL  # noqa: F401


def op1_licenses(spark, sf_dir):
    found = licenses.scan(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_quality(spark, sf_dir):
    found = quality.apply_rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op3_chat(spark, sf_dir):
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(rows.unionAll(probe))


def op4_ppm(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    model = ppm.train(docs.where(~ppm.held_out(F.col("doc_id"))))
    found = ppm.predict(docs, model)
    return found.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark, sf_dir):
    found = mixing.mix(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_pseudo(spark, sf_dir):
    return pseudo.score(common.read(spark, sf_dir, "documents"))


def op7_suffix(spark, sf_dir):
    return suffix.repeat_digests(common.read(spark, sf_dir, "documents"), length=100)


def op8_simhash(spark, sf_dir):
    found = simhash.simhash_components(common.read(spark, sf_dir, "documents"), k=3, distance=2)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op9_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op10_weak(spark, sf_dir):
    return weak.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op11_pii(spark, sf_dir):
    return pii.digests(common.read(spark, sf_dir, "documents"))


def op12_trie(spark, sf_dir):
    return trie.rebuilt_trie(common.read(spark, sf_dir, "conversations"))


def op13_codes(spark, sf_dir):
    found = codes.compress(common.read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_ppm": op4_ppm,
    "op5_mixing": op5_mixing,
    "op6_pseudo": op6_pseudo,
    "op7_suffix": op7_suffix,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_weak": op10_weak,
    "op11_pii": op11_pii,
    "op12_trie": op12_trie,
    "op13_codes": op13_codes,
}

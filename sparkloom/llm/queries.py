"""The queries op1_ to op13_: each applies its operator to the whole of its table and returns the contract's columns first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, language, licences, merkle, mixing, near_duplicates, personal_data, quality, secrets, sharding, suffixes, warc
from .common import read_table, stored


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents, one row each, cutoffs by language (a null language is one). A null or empty text has no words and
    fails; repeated rows are judged alike."""
    scores = stored(quality.scores(read_table(spark, sf_dir, "documents")), "quality-scores")
    out = quality.judged(scores, quality.limits(scores, quality.good_ids(read_table(spark, sf_dir, "labels"))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "badness", "cutoff")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text. A null or empty text has no spans; repeated rows give equal rows."""
    return personal_data.personal_data(read_table(spark, sf_dir, "documents"))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of rows. Null texts have size 16 and checksum 0, null sources are a source, repeated
    rows get slots of their own."""
    out = sharding.shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links of 80 per cent on 4-word shingles. Texts without a word stand alone; rows of one doc_id are one
    node; without a doc_id a row has no component and is kept."""
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op5_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every text names or quotes. A null, empty or one-word text has none (null)."""
    out = licences.licences(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["licence"], F.round(x["dice"], 6).cast("string"))), ",")
    return out.select("doc_id", "licence", F.round("dice", 6).alias("dice"), "n_matches", spans.alias("matches"))


def op6_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Null and empty texts have size 0 and are never taken; a null source is the last source;
    repeated rows count as rows of their own."""
    out = mixing.mix(stored(mixing.sized(read_table(spark, sf_dir, "documents"), []), "mixing-words"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records, normalised and read back. A null html is an empty payload, a null page_id stays null; equal rows are
    all response."""
    out = warc.archive(read_table(spark, sf_dir, "pages"), html=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text. A null or empty text has no spans; repeated rows give equal rows."""
    out = secrets.secrets(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined(F.col("found"), secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"), "n_entropy")


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text. Null texts and texts without a letter are und with score 0; a null doc_id counts as held out."""
    return language.identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null texts have no words; items without an id or text are left out."""
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds and a last assignment. Vectors of another length, or with a component that is null or not
    finite, are left out; repeated rows are vectors of their own."""
    out = clustering.clustered(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document. Null columns are told from empty ones; a null source is the first; rows without a doc_id
    come first and are never tampered with; repeated rows are leaves of their own."""
    out = merkle.manifest(read_table(spark, sf_dir, "documents"), also={"tampered": merkle.tampered_leaf()})
    out = merkle.verified(out, F.coalesce("tampered", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified", "source")


def op13_radix_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 50 bytes that start in a document of smaller doc_id. Null texts are empty; rows without a
    doc_id keep all and remove nothing; repeated rows give equal rows."""
    out = suffixes.repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_personal_data, op3_stratified_shards, op4_superminhash, op5_licence_dice, op6_subset_sum_mix, op7_warc_members, op8_entropy_secrets, op9_cross_parsing, op10_winnowing, op11_delta_lloyd, op12_merkle_manifest, op13_radix_suffixes)
    return {f.__name__: f for f in own}

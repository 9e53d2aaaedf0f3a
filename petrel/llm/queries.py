"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .collocations import collocations
from .exact_dedup import exact_dedup
from .line_dedup import dedup_lines
from .mixing import mix
from .prefix_trie import conversation_trie
from .quality_classifier import classify
from .quality_rules import quality_rules
from .secrets import scan_secrets, span_list
from .sentencepiece_codec import encode
from .simhash import simhash_groups
from .suffix_dedup import suffix_dedup
from .url_filters import judge_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    counts = [F.col(f"_{c}").alias(c) for c in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    return out.select("doc_id", *counts, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), ids=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_list(F.filter("spans", lambda x: x["kind"] != "random"))
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_list(F.filter("spans", lambda x: x["kind"].isin(*pii.KINDS[: pii.BASE])))
    return out.select("doc_id", *[of(k) for k in pii.KINDS[: pii.BASE]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_line_dedup, op3_exact_dedup, op4_sentencepiece, op5_suffix_dedup, op6_mixing, op7_secret_scans, op8_simhash, op9_quality_rules, op10_quality_classifier, op11_collocations, op12_prefix_trie, op13_pii)}

"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.llm import ann_ads, ctw, decontam, erasure, filter_audit, jaccard_join, mix_pareto, nbsvm, ordinal, paragraph_minhash, pii_crf, suffix_bpr, warc_index
from curatrix.llm.common import read


def op1_crf_pii(spark, sf_dir):
    return pii_crf.personal_data(read(spark, sf_dir, "documents"))


def op2_ads_neighbours(spark, sf_dir):
    return ann_ads.neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_nbsvm_toxicity(spark, sf_dir):
    return nbsvm.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_suffix_bpr_dedup(spark, sf_dir):
    return suffix_bpr.dedup(read(spark, sf_dir, "documents"))


def op5_ctw_scoring(spark, sf_dir):
    return ctw.scores(read(spark, sf_dir, "documents"))


def op6_pareto_mix(spark, sf_dir):
    return mix_pareto.mix_report(read(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark, sf_dir):
    return ordinal.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_spaced_seed_decontamination(spark, sf_dir):
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_paragraph_minhash(spark, sf_dir):
    return paragraph_minhash.clusters(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_documents(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_erasure_rewrite(spark, sf_dir):
    return erasure.cascade(spark, *[read(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")])


def op13_warc_index(spark, sf_dir):
    found = warc_index.archive_and_index(spark, read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position", "url_key", "capture_no", "captured_at", "archive", "offset", "length")


QUERIES = {
    "op1_crf_pii": op1_crf_pii,
    "op2_ads_neighbours": op2_ads_neighbours,
    "op3_nbsvm_toxicity": op3_nbsvm_toxicity,
    "op4_suffix_bpr_dedup": op4_suffix_bpr_dedup,
    "op5_ctw_scoring": op5_ctw_scoring,
    "op6_pareto_mix": op6_pareto_mix,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_spaced_seed_decontamination": op8_spaced_seed_decontamination,
    "op9_paragraph_minhash": op9_paragraph_minhash,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_erasure_rewrite": op12_erasure_rewrite,
    "op13_warc_index": op13_warc_index,
}

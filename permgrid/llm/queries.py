"""Registered queries of the numbered operators: name -> job, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from permgrid.llm import decontaminate, topk
from permgrid.llm.alignment import alignment_report, default_paths
from permgrid.llm.decontaminate import contaminated_documents
from permgrid.llm.jaccard_join import near_duplicate_documents
from permgrid.llm.langid import identify
from permgrid.llm.lblm import score_language
from permgrid.llm.licenses import scan_licenses
from permgrid.llm.line_dedup import line_dedup_report
from permgrid.llm.packing import default_tokenizer, pack_documents
from permgrid.llm.quality_crf import score_quality
from permgrid.llm.secrets import scan_secrets
from permgrid.llm.spelling import spelling_variants
from permgrid.llm.topk import search_every_hundredth
from permgrid.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_line_dedup")
def op1(spark, sf_dir):
    return line_dedup_report(table(spark, sf_dir, "documents"), exact_words=1)


@query("op2_packing")
def op2(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


@query("op3_language_id")
def op3(spark, sf_dir):
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op4_exact_top_k", topk.ORACLE)
def op4(spark, sf_dir):
    return search_every_hundredth(table(spark, sf_dir, "embeddings"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_decontamination", decontaminate.ORACLE)
def op6(spark, sf_dir):
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return near_duplicate_documents(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality_crf")
def op9(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return alignment_report(table(spark, sf_dir, "documents"), default_paths())


@query("op13_lm_scoring")
def op13(spark, sf_dir):
    return score_language(table(spark, sf_dir, "documents"))

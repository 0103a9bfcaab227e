"""The corpus operators as registered queries, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, licenses, packing, periodic_runs, pii, quality, quality_rules, simhash, token_output, toxicity, vector_codes, warc
from .common import new_path, read_table
from .tokens import default_vocabulary


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), default_vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "op4")
    manifest = token_output.write_token_files(read_table(spark, sf_dir, "documents"), out, default_vocabulary())
    return token_output.digest_files(spark, manifest)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "op8")
    warc.write_archive(read_table(spark, sf_dir, "pages"), out)
    return warc.digests(warc.read_archive(spark, out))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("_id", "_key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_best_fit_packing,
        op3_quality,
        op4_token_files,
        op5_toxicity,
        op6_simhash,
        op7_quality_rules,
        op8_warc,
        op9_decontamination,
        op10_pii,
        op11_vector_codes,
        op12_licenses,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": quality_rules.SQL,
    "op8_warc": warc.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_licenses": licenses.SQL,
}

"""Registered corpus queries: each applies its operator to a whole table."""

from __future__ import annotations

from . import bpe, brown, decontaminate, langid, media, nearjoin, quality, setjoin, substring, toxicity


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op2_brown(spark, sf_dir):
    return brown.score_documents(documents(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), *tokenizer())


def op4_langid(spark, sf_dir):
    return langid.identify_documents(documents(spark, sf_dir))


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark, sf_dir):
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_quality(spark, sf_dir):
    return quality.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_license(spark, sf_dir):
    return setjoin.license_labels(documents(spark, sf_dir))


def op5_license_wrapped(spark, sf_dir):
    return setjoin.license_labels(documents(spark, sf_dir), wrapped=True)


def op7_nearjoin(spark, sf_dir):
    return nearjoin.classify(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "links")


def op8_substring(spark, sf_dir):
    return substring.digests(documents(spark, sf_dir)).drop("removed")


def op10_media(spark, sf_dir):
    return media.stored_texts(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_brown, op3_bpe, op4_langid, op5_license, op5_license_wrapped, op6_toxicity, op7_nearjoin, op8_substring, op9_quality, op10_media)}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": decontaminate.oracle(), "op5_license": setjoin.oracle(), "op5_license_wrapped": setjoin.wrapped_oracle(), "op8_substring": substring.oracle()}

"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, and
token-id files. Each stage works on all that the stage before it kept.

A stage's result is lazy and may be read at any time, by any number of later stages; what a stage staged on its way to a
decision is dropped when the decision is written. ``run`` writes each stage's result and drops what the stage before
left when nothing reads it any more. A null text is an empty text, an empty table gives an empty result, rows of
equal or null doc_id are each on their own, and further columns pass through (row_key_ and names that
begin with mix_ are taken)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import decontaminate, mixing, near_join, quality, tokens
from pagewarden.llm.shared import ROW_KEY, drop_tables, settled, staged_tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio, each row with a number of its own."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    # written first: Spark would else compute the verdict's parts again for the filter
    def told() -> DataFrame:
        return quality.judge(docs, trusted).select("doc", "verdict.kept", F.monotonically_increasing_id().alias(ROW_KEY))

    return settled(told, "quality-judged").where("kept").select("doc.*", ROW_KEY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_join.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark")).drop(ROW_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs, settled(lambda: mixing.mix(docs), "mixed"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, read back: doc_id, start, n_tokens, ids_crc32 of each document."""
    return tokens.read_token_ids(tokens.write_token_ids(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: Hashed likelihood ratios, random rounding and the tokenizer have no SQL form; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), []
    for name, work in STAGES:
        with staged_tables() as made:
            docs = settled(lambda: work(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(before)
        before = made
    return docs

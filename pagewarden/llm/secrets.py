"""Secret scans on an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a table
in shared storage, holds the findings of each (blob, rule version) that was ever scanned. A
run scans only pairs that the ledger lacks, adds them, and joins findings back to all paths
and versions.

Defined results: a null content counts as empty; equal contents, whatever their path, are
scanned once and report the same spans; a null path is a path like any other; repeated rows
each get their findings; an empty table gives an empty result; further columns pass
through, but for own ones named blob or spans, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, small_side, stage_table

#: kind, pattern, group that is measured, least length; in the order of ties
RULES = (
    ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    # maximal runs shorter than the least length hold no match, so the length stands in the pattern
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
RULE_VERSION = 1

_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def scan_text(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """kind, start, end (code points) by start, then by the rules' order."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(rules):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t or "", rules)] for t in batch.column("text").to_pylist()
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, kind)], ["blob", "spans"])

    return scan


def content_address(text) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """Findings by blob and rule version, in ``folder`` of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or new_folder(spark, "blob-ledger")

    def findings(self, rule_version: int) -> DataFrame:
        """blob and spans of every blob that was scanned with the rules of that version."""
        try:
            held = self.spark.read.schema(f"blob string, spans {_SPANS}, rule_version int").parquet(self.folder)
        except AnalysisException:  # nothing was ever scanned
            return self.spark.createDataFrame([], f"blob string, spans {_SPANS}")
        return held.where(F.col("rule_version") == rule_version).select("blob", "spans")

    def scan_new(self, versions: DataFrame, rule_version: int = RULE_VERSION, rules=RULES, path: str = "doc_id") -> None:
        """Scans the blobs of ``versions`` that the ledger lacks for the version and adds them.

        Only addresses and paths are grouped; then the text of each new blob is taken from the
        row of its smallest path (of rows equal in path and text each is scanned, and one kept), so no
        text is shuffled unless the new blobs are many. Both sides name a row by its own values."""
        named = F.coalesce(F.col(path).cast("string"), F.lit("")).alias("at")
        rows = versions.select(content_address(F.col("text")).alias("blob"), named, F.coalesce("text", F.lit("")).alias("text"))
        unseen = rows.groupBy("blob").agg(F.min("at").alias("at")).join(self.findings(rule_version).select("blob"), "blob", "left_anti")
        unseen = small_side(stage_table(unseen, "blobs-unseen"))
        texts = rows.join(unseen, ["blob", "at"]).select("blob", "text")
        found = texts.mapInArrow(_scan(rules), f"blob string, spans {_SPANS}")
        stage_table(found, "blobs-scanned").dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(self.folder)


def scan_versions(versions: DataFrame, ledger: BlobLedger, rule_version: int = RULE_VERSION, rules=RULES, path: str = "doc_id") -> DataFrame:
    """All columns of ``versions`` but the text (``path``, and what else tells versions apart), blob and
    spans of every row, scanning only what is new. A run that adds the same blobs at the same time may
    write some twice; they are read once."""
    ledger.scan_new(versions, rule_version, rules, path)
    found = ledger.findings(rule_version).where(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias("blob_of_"), "spans")
    others = [c for c in versions.columns if c not in ("text", "blob", "spans")]
    addressed = versions.select(*others, content_address(F.col("text")).alias("blob"))
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    joined = addressed.join(small_side(stage_table(found, "blobs-found")), F.col("blob") == F.col("blob_of_"), "left")
    return joined.select(*others, "blob", spans.alias("spans"))

"""Scorers that are plugged in: a model takes batches of texts and gives spans; without one there are none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom

#: What a scorer gives for a batch of texts: for each text its spans (label, value, start in code points, logit).
Scorer = Callable[[list[str]], list[list[tuple[str, str, int, float]]]]
SPANS = "label string, value string, start int, logit double"
_SPANS = [("label", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("logit", pa.float64())]


def scored_spans(texts: DataFrame, load: Callable[[], Scorer] | None, key: str = "page_id", text: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """key, label, value, start, logit of every span that a scorer finds in ``texts``, for ``scans.model_pii``. ``load`` is called once in each
    task and gives the scorer, or None where there is no model: then, and without ``load``, the result is empty. Texts come in batches of about
    ``batch_bytes``; null texts are not scored."""
    kind = dict(texts.dtypes)[key]
    if load is None:
        return texts.sparkSession.createDataFrame([], f"{key} {kind}, {SPANS}")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for batch in batches if scorer is not None else ():
            for some in dom.page_slices(batch, text, batch_bytes):
                rows = [(k, *span) for k, spans in zip(some.column(0).to_pylist(), scorer(some.column(1).to_pylist())) for span in spans]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], some.schema.field(0).type), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], _SPANS)]], [key, *[n for n, _ in _SPANS]])

    return texts.where(F.col(text).isNotNull()).select(key, text).mapInArrow(score, f"{key} {kind}, {SPANS}")

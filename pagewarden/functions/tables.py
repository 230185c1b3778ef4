"""Table functions for SQL: ``SELECT ... FROM pages, LATERAL dom_elements(html)`` and ``LATERAL md_chunks(text, most, overlap)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import dom, views

DOM_COLUMNS = dom.ELEMENTS.partition(", ")[2]
CHUNK_COLUMNS = "chunk int, n_chunks int, start bigint, end bigint, prefix string, content string, has_more boolean"


class DomElements:
    """The elements of one page, as ``dom.elements`` gives them; null has none."""

    def eval(self, html: str) -> Iterator[tuple]:
        for row in dom.element_rows(None, html):
            page = list(row[1:])
            page[5] = dict(page[5])
            yield tuple(page)


class MdChunks:
    """The chunks of one text, as ``views.markdown_chunks`` gives them; null and empty texts have one empty chunk."""

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple]:
        yield from views.text_chunks(text, most, overlap)


def register(spark: SparkSession) -> None:
    """Makes both functions known to the session's SQL; rows pass in Arrow batches."""
    spark.udtf.register("dom_elements", F.udtf(DomElements, returnType=DOM_COLUMNS, useArrow=True))
    spark.udtf.register("md_chunks", F.udtf(MdChunks, returnType=CHUNK_COLUMNS, useArrow=True))

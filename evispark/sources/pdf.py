"""Pages of PDF files. The PDF library is optional: without it the engine begins at tables of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_sha256, page_number, text, error): one row a page, from 1; a file that can't be read is one row with its error.

    Raises ImportError where no PDF library is installed.
    """
    import fitz  # noqa: F401

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import fitz

        for batch in batches:
            out: list[tuple] = []
            for name, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with fitz.open(stream=content, filetype="pdf") as doc:
                        out += [(name, digest, i + 1, page.get_text("text"), None) for i, page in enumerate(doc)]
                except Exception as e:  # one broken file loses only itself
                    out.append((name, digest, None, None, str(e)[:500]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file_name", "file_sha256", "page_number", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("file_sha256"), "content")
    return files.mapInArrow(run, "file_name string, file_sha256 string, page_number int, text string, error string")

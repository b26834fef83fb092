"""XML files as rows, one per element, in document order: what the AP242 and SVG readers start from."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

ELEMENTS = "file string, id long, parent long, tag string, attrs map<string,string>, text string, _corrupt_record string"


def elements(text: str) -> Iterator[tuple]:
    """(id, parent, tag, attrs, text) of each element as it ends; names without their namespace."""
    local = lambda x: x.rpartition("}")[2]
    stack: list[int] = []
    n = 0
    for event, e in ET.iterparse(io.BytesIO(text.encode()), events=("start", "end")):
        if event == "start":
            stack.append(n)
            n += 1
            continue
        own = stack.pop()
        yield own, stack[-1] if stack else None, local(e.tag), [(local(k), v) for k, v in e.attrib.items()], (e.text or "").strip() or None
        e.clear()


def parse(texts: DataFrame, batch: int = 4096) -> DataFrame:
    """Elements of ``texts`` (file, text). A file that isn't well-formed gives what it has up to there, and the problem as _corrupt_record."""
    ship(texts.sparkSession)
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for p in parts:
            for file, text in zip(p.column("file").to_pylist(), p.column("text").to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for x in elements(text or ""):
                        rows.append((file, *x, None))
                        if len(rows) >= batch:
                            yield made(rows)
                            rows = []
                except ET.ParseError as e:
                    rows.append((file, None, None, None, None, None, str(e)))
                yield made(rows)

    return texts.select("file", "text").mapInArrow(task, ELEMENTS)


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"), F.col("value").alias("text"))
    return parse(files)

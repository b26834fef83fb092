"""Exchange files of ISO 10303-21: entity instances and their positional values as rows.

A file is read by one task, as its records can't be told apart from the middle; many files spread. Simple and
complex instances give one row per partial entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

INSTANCES = "file string, id long, part int, entity string, args array<string>, _corrupt_record string"
#: Fixed values of the format: what a token can be. A string doubles its quote; comments and blanks part tokens.
_TOKEN = re.compile(
    r"(?:\s|/\*.*?\*/)*(?:(?P<string>'(?:[^']|'')*')|(?P<ref>#\s*[0-9]+)|(?P<binary>\"[0-9A-Fa-f]*\")|(?P<enum>\.[A-Za-z0-9_]+\.)"
    r"|(?P<number>[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)|(?P<name>!?[A-Za-z_][A-Za-z0-9_-]*)|(?P<sign>[(),;=$*&/]))",
    re.S,
)


class P21Problem(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        yield m.lastgroup, m[m.lastgroup]
    if text[at:].strip():
        raise P21Problem(f"not a token: {text[at : at + 20]!r}")


def _list(tokens: Iterator) -> list[str]:
    """The values up to the closing bracket, each as text; lists and typed values keep their brackets."""
    out: list[str] = []
    held: list[str] = []
    depth = 0
    for kind, t in tokens:
        if kind == "sign" and t == "(":
            depth += 1
        elif kind == "sign" and t == ")":
            if not depth:
                if held or out:
                    out.append("".join(held))
                return out
            depth -= 1
        elif kind == "sign" and t == "," and not depth:
            out.append("".join(held))
            held = []
            continue
        held.append(t.replace(" ", "") if kind == "ref" else t)
    raise P21Problem("a bracket isn't closed")


def records(text: str) -> Iterator[list[tuple[str, str]]]:
    """The tokens of each record; a full stop of records is ``;``."""
    own: list[tuple[str, str]] = []
    for kind, t in _tokens(text):
        if kind == "sign" and t == ";":
            yield own
            own = []
        else:
            own.append((kind, t))


def instances(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    """(id, part, entity, args) of every partial entity in the data sections."""
    data = False
    for r in records(text):
        if not r:
            continue
        if r[0] == ("name", "DATA"):
            data = True
        elif r[0] == ("name", "ENDSEC"):
            data = False
        elif data and r[0][0] == "ref":
            if len(r) < 3 or r[1] != ("sign", "="):
                raise P21Problem("an instance has no value")
            number, several = int(r[0][1].lstrip("# \n\t")), r[2] == ("sign", "(")
            rest = iter(r[3 if several else 2 :])
            for part, (kind, name) in enumerate(rest):
                if kind != "name":
                    break
                if next(rest, None) != ("sign", "("):
                    raise P21Problem("an entity has no values")
                yield number, part, name.upper(), _list(rest)


def parse(texts: DataFrame) -> DataFrame:
    """Instances of ``texts`` (file, text): file, id, part, entity, args. A file with a problem gives it as _corrupt_record."""
    ship(texts.sparkSession)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INSTANCES.split(", ")]
        for p in parts:
            for file, text in zip(p.column("file").to_pylist(), p.column("text").to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    rows += [(file, *x, None) for x in instances(text or "")]
                except P21Problem as e:
                    rows.append((file, None, None, None, None, str(e)))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return texts.select("file", "text").mapInArrow(task, INSTANCES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Instances of all files of a path."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"), F.col("value").alias("text"))
    return parse(files)

"""Turtle and TriG: a reader that runs one task per file, and a writer that is an aggregate.

Blank nodes are named after their file and their place in it, so reading twice gives the same rows. A file
isn't splittable, for prefixes reach to its end; many files are read in parallel.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EX, FIRST, NIL, OWL, RDF, RDFS, SCHEMA, TYPE, XSD, conform
from ..operators.graphs import checkpointed
from ..shipping import ship


class SyntaxProblem(ValueError):
    """What is wrong, and in which line."""


_TOKEN = re.compile(
    r"""(?P<skip>[\s]+|\#[^\n]*)
  |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<dtype>\^\^)
  |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
  |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-·:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-·:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<key>[A-Za-z]+)
  |(?P<punct>[.;,\[\](){}])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    """Numeric and character escapes resolved."""

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU" and len(x) > 1:
            return chr(int(x[1:], 16))
        if x not in _CHARS:
            raise SyntaxProblem(f"unknown escape \\{x}")
        return _CHARS[x]

    return _ESCAPE.sub(one, s) if "\\" in s else s


class Parser:
    """Yields (graph, subject, predicate, object); a term is (kind, value, datatype, language), graph a string or None."""

    def __init__(self, text: str, base: str = "", name: str = "", trig: bool = False):
        self.text, self.base, self.trig = text, base, trig
        self.stem = hashlib.sha1(name.encode()).hexdigest()[:12]
        self.prefixes: dict[str, str] = {}
        self.blanks = 0
        self.graph: str | None = None
        self.out: list[tuple] = []
        self.at = 0
        self._step()

    def _fail(self, what: str) -> SyntaxProblem:
        return SyntaxProblem(f"line {self.text.count(chr(10), 0, self.start) + 1}: {what}")

    def _step(self) -> None:
        while True:
            self.start = self.at
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                self.kind, self.value = "bad", self.text[self.at]
                raise self._fail(f"unexpected {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return

    def _take(self, value: str) -> bool:
        if self.kind in ("punct", "dtype") and self.value == value:
            self._step()
            return True
        return False

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise self._fail(f"{value} expected before {self.value!r}")

    def _iri(self) -> str:
        kind, value = self.kind, self.value
        if kind == "iri":
            self._step()
            return urljoin(self.base, unescape(value[1:-1])) if self.base else unescape(value[1:-1])
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise self._fail(f"unknown prefix {prefix!r}")
            self._step()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise self._fail(f"an IRI expected, not {value!r}")

    def _fresh(self) -> tuple:
        self.blanks += 1
        return ("blank", f"_:{self.stem}-{self.blanks}", None, None)

    def _emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((self.graph, s, p, o))

    def _subject(self) -> tuple:
        if self.kind == "blank":
            v = self.value
            self._step()
            return ("blank", f"_:{self.stem}.{v[2:]}", None, None)
        if self.kind == "punct" and self.value in "[(":
            return self._bracket()
        return ("iri", self._iri(), None, None)

    def _bracket(self) -> tuple:
        if self._take("["):
            b = self._fresh()
            if not self._take("]"):
                self._properties(b)
                self._need("]")
            return b
        self._need("(")
        cells = []
        while not self._take(")"):
            cells.append(self._object())
        if not cells:
            return ("iri", NIL, None, None)
        nodes = [self._fresh() for _ in cells]
        for i, (n, o) in enumerate(zip(nodes, cells, strict=True)):
            self._emit(n, FIRST, o)
            self._emit(n, f"{RDF}rest", nodes[i + 1] if i + 1 < len(nodes) else ("iri", NIL, None, None))
        return nodes[0]

    def _object(self) -> tuple:
        kind, value = self.kind, self.value
        if kind in ("str", "long"):
            self._step()
            n = 3 if kind == "long" else 1
            text = unescape(value[n:-n])
            if self.kind == "word" and self.value.lower() not in ("@prefix", "@base"):
                lang = self.value[1:]
                self._step()
                return ("lit", text, f"{RDF}langString", lang)
            if self._take("^^"):
                return ("lit", text, self._iri(), None)
            return ("lit", text, f"{XSD}string", None)
        if kind == "num":
            self._step()
            return ("lit", value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if kind == "key" and value in ("true", "false"):
            self._step()
            return ("lit", value, f"{XSD}boolean", None)
        return self._subject()

    def _properties(self, s: tuple) -> None:
        while True:
            if self.kind == "key" and self.value == "a":
                self._step()
                p = TYPE
            else:
                p = self._iri()
            self._emit(s, p, self._object())
            while self._take(","):
                self._emit(s, p, self._object())
            if not self._take(";"):
                return
            while self._take(";"):
                pass
            if self.kind == "punct" and self.value in ".]}":
                return

    def _directive(self) -> bool:
        word = self.value.lower()
        at = self.kind == "word" and self.value in ("@prefix", "@base")
        if not at and not (self.kind == "key" and word in ("prefix", "base")):
            return False
        self._step()
        if word.endswith("prefix"):
            if self.kind != "name" or not self.value.endswith(":"):
                raise self._fail("a prefix expected")
            name = self.value[:-1]
            self._step()
            if self.kind != "iri":
                raise self._fail("an IRI expected")
            self.prefixes[name] = self._iri()
        else:
            if self.kind != "iri":
                raise self._fail("an IRI expected")
            self.base = self._iri()
        if at:
            self._need(".")
        return True

    def _triples(self) -> None:
        alone = self.kind == "punct" and self.value == "["
        s = self._subject()
        if not (alone and self.kind == "punct" and self.value in ".}"):
            self._properties(s)

    def _statement(self) -> None:
        if self._directive():
            return
        if self.trig and (self.value == "{" or self.kind == "key" and self.value.lower() == "graph"):
            if self.kind == "key":
                self._step()
            return self._block(None if self.value == "{" else self._iri())
        if self.trig and self.kind in ("iri", "name"):
            here = (self.at, self.start, self.kind, self.value)
            g = self._iri()
            if self.kind == "punct" and self.value == "{":
                return self._block(g)
            self.at, self.start, self.kind, self.value = here
        self._triples()
        self._need(".")

    def _block(self, graph: str | None) -> None:
        self._need("{")
        self.graph = graph
        while not self._take("}"):
            self._triples()
            if not self._take(".") and not (self.kind == "punct" and self.value == "}"):
                raise self._fail(". expected")
        self.graph = None

    def parse(self, mode: str = "FAILFAST") -> Iterator[tuple | SyntaxProblem]:
        """Triples of the text. FAILFAST raises at the first problem; DROPMALFORMED goes on after the next full stop;
        PERMISSIVE does so too, and yields the problem."""
        while self.kind != "end":
            held = len(self.out)
            try:
                self._statement()
            except SyntaxProblem as e:
                if mode == "FAILFAST":
                    raise
                del self.out[held:]
                self.graph = None
                if mode == "PERMISSIVE":
                    yield e
                m = re.compile(r"\.\s*(?:\n|$)").search(self.text, self.start)
                self.at = m.end() if m else len(self.text)
                while True:
                    try:
                        self._step()
                        break
                    except SyntaxProblem:
                        self.at += 1
            yield from self.out
            self.out = []


READ = SCHEMA + ", _corrupt_record string"


def _rows(text: str, name: str, mode: str, trig: bool = False) -> Iterator[tuple]:
    trig = trig or name.endswith(".trig")
    found = list(Parser(text, name=name, trig=trig).parse(mode))
    whole = next((s[1] for x in found if not isinstance(x, SyntaxProblem) for _, s, p, o in [x] if p == TYPE and o[1] == f"{OWL}Ontology"), None)
    base = lambda s: s.partition("#")[0]
    named = next((base(x[1][1]) for x in found if not isinstance(x, SyntaxProblem) and x[1][0] == "iri"), f"urn:file:{name}")
    stated: set[str] = set()
    for x in found:
        if isinstance(x, SyntaxProblem):
            yield (None,) * 10 + (str(x),)
            continue
        g, (sk, s, _, _), p, (ok, o, dtype, lang) = x
        ng = (g or whole or named).removesuffix("#")
        # that a graph is an ontology goes without saying: the first such triple is left out, and the writer puts it back
        if p == TYPE and o == f"{OWL}Ontology" and ng not in stated:
            stated.add(ng)
            continue
        yield (ng, sk, s, p, "lit" if ok == "lit" else "node", o, dtype, lang, None, None, None)


def read(spark: SparkSession, path: str, mode: str = "FAILFAST", trig: bool = False) -> DataFrame:
    """The triples of Turtle and TriG files (.trig, or all with ``trig``), but for the first that calls a graph an ontology; lists stay rdf:first/rest rows (see ``operators.lists.collapse``).

    ``mode``: FAILFAST, DROPMALFORMED, or PERMISSIVE with problems in ``_corrupt_record``."""
    ship(spark)
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("name"))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for text, name in zip(p["value"], p["name"], strict=True):
                yield pd.DataFrame(list(_rows(text, name, mode, trig)), columns=[c.split()[0] for c in READ.split(", ")])

    return files.mapInPandas(task, READ)


def imports(t: DataFrame) -> DataFrame:
    """Import edges, which the triples state as owl:imports."""
    return t.where(F.col("p") == f"{OWL}imports").select(F.col("ng").alias("importer"), F.regexp_replace("o", "#$", "").alias("imported")).distinct()


def parse_text(text: str, trig: bool = False, mode: str = "FAILFAST") -> list[tuple]:
    """The rows of one text, for use without Spark."""
    return list(_rows(text, "text.trig" if trig else "text.ttl", mode))


#: The usual prefixes.
PREFIXES = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}


def _iri(c: Column, prefixes: dict[str, str]) -> Column:
    """An IRI in brackets, or as a prefixed name where a prefix fits and the rest needs no escape."""
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for name, base in sorted(prefixes.items(), reverse=True):
        rest = c.substr(F.lit(len(base) + 1), F.length(c))
        out = F.when(c.startswith(base) & rest.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{name}:"), rest)).otherwise(out)
    return out


def _term(kind: Column, o: Column, dtype: Column, lang: Column, prefixes: dict[str, str]) -> Column:
    text = o
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    lit = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(dtype.isNull() | (dtype == XSD + "string"), quoted).otherwise(F.concat(quoted, F.lit("^^"), _iri(dtype, prefixes)))
    return F.when(kind == "lit", lit).when(o.startswith("_:"), F.concat(F.lit("_:b"), F.regexp_replace(o, "[^A-Za-z0-9]", ""))).otherwise(_iri(o, prefixes))


def _bodies(rows: DataFrame) -> DataFrame:
    """Per node: body (its predicates and objects, grouped and sorted) and members (of a list). Rows: ng, s, p, ot, member_idx."""
    first = F.col("p") == FIRST
    own = rows.where(~first | F.col("member_idx").isNull()).groupBy("ng", "s", F.col("pt")).agg(F.array_join(F.sort_array(F.collect_set("ot")), " , ").alias("os"))
    own = own.groupBy("ng", "s").agg(F.array_sort(F.collect_list(F.struct((F.col("pt") != "a").alias("k"), "pt", "os"))).alias("ls"))
    own = own.select("ng", "s", F.array_join(F.transform("ls", lambda x: F.concat(x["pt"], F.lit(" "), x["os"])), " ;\n    ").alias("body"))
    held = rows.where(first & F.col("member_idx").isNotNull()).groupBy("ng", "s").agg(F.array_sort(F.collect_list(F.struct("member_idx", "ot"))).alias("m"))
    held = held.select("ng", "s", F.array_join(F.transform("m", lambda x: x["ot"]), " ").alias("members"))
    return own.join(held, ["ng", "s"], "full_outer")


def statements(t: DataFrame, prefixes: dict[str, str] | None = None, depth: int = 4) -> DataFrame:
    """One text per subject: ng, ord (the ontology node first, then by name), s, text. Predicates and objects are grouped and sorted.

    Blank nodes that are used once, and lists (rdf:first rows with places) that have nothing else, are put where they are used, as deep
    as ``depth`` of them stand in one another; what is deeper, or on a circle, keeps its label."""
    prefixes = PREFIXES if prefixes is None else prefixes
    pt = F.when(F.col("p") == TYPE, "a").otherwise(_iri(F.col("p"), prefixes)).alias("pt")
    rows = t.select("ng", "s", "p", "o_kind", "o", pt, _term(F.col("o_kind"), F.col("o"), F.col("o_dtype"), F.col("o_lang"), prefixes).alias("ot"), "member_idx")
    uses = t.where("o_kind <> 'lit' and o like '_:%'").groupBy(F.col("o").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("ng").alias("ng"))
    once = checkpointed(t.where("s_kind = 'blank'").select("ng", "s").distinct().join(uses.where("n = 1").select("ng", "s"), ["ng", "s"]))
    listed = t.where((F.col("p") == FIRST) & F.col("member_idx").isNotNull()).select("s").distinct()
    done = once.select("ng", "s", F.lit("").alias("inner")).where(F.lit(False))
    placed = lambda d: rows.join(d.select("ng", F.col("s").alias("o"), F.col("inner").alias("_in")), ["ng", "o"], "left").withColumn("ot", F.when((F.col("o_kind") != "lit") & F.col("_in").isNotNull(), F.col("_in")).otherwise(F.col("ot")))
    for _ in range(depth):
        left = once.join(done, ["ng", "s"], "left_anti")
        waits = rows.join(left.select("ng", F.col("s").alias("o")), ["ng", "o"], "left_semi").select("ng", "s")
        ready = left.join(waits, ["ng", "s"], "left_anti")
        text = F.when(F.col("body").isNull(), F.concat(F.lit("( "), "members", F.lit(" )"))).otherwise(F.concat(F.lit("[ "), "body", F.lit(" ]")))
        # a list that has more than its members can't be written in place
        new = _bodies(placed(done).join(ready, ["ng", "s"], "left_semi")).where("body is null or members is null").select("ng", "s", text.alias("inner"))
        new = checkpointed(new)
        if new.isEmpty():
            break
        done = done.union(new)
    every = _bodies(placed(done)).join(done.select("ng", "s"), ["ng", "s"], "left_anti").join(listed.withColumn("_l", F.lit(True)), "s", "left")
    name = _term(F.lit("node"), F.col("s"), F.lit(None).cast("string"), F.lit(None).cast("string"), prefixes)
    one = F.when(F.col("members").isNull(), F.col("body")).otherwise(F.concat_ws(" ;\n    ", "body", F.concat(F.lit(f"<{MEMBERS}> ( "), "members", F.lit(" )"))))
    own = F.when(F.col("s") == F.col("ng"), 0).otherwise(1)
    return every.select("ng", own.alias("ord"), "s", F.concat(name, F.lit(" "), one, F.lit(" .")).alias("text"))


#: How a list that can't stand where it is used has its members: as one list.
MEMBERS = f"{EX}members"


def _with_ontology(t: DataFrame) -> DataFrame:
    """``t`` with the triple that every graph's file starts with: that the graph is an ontology."""
    made = t.select("ng").distinct().select("ng", F.lit("iri").alias("s_kind"), F.col("ng").alias("s"), F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), F.lit(f"{OWL}Ontology").alias("o"))
    return conform(t).unionByName(made, allowMissingColumns=True)


def _header(prefixes: dict[str, str]) -> str:
    return "\n".join(f"@prefix {k}: <{v}> ." for k, v in sorted(prefixes.items()))


def write(t: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Turtle, a folder per graph (ng as URL-safe Base64) with one file: prefixes, the ontology node, then all subjects by name.

    One file, as blank nodes' labels hold within a file only; a task writes a graph."""
    from ..functions.scalars import base64_url

    prefixes = PREFIXES if prefixes is None else prefixes
    out = statements(_with_ontology(t), prefixes).select("ng", "ord", "s", "text")
    head = t.select("ng").distinct().select("ng", F.lit(-1).alias("ord"), F.lit("").alias("s"), F.lit(_header(prefixes)).alias("text"))
    out = out.unionByName(head if prefixes else head.where(F.lit(False))).withColumn("graph", base64_url(F.col("ng")))
    out.repartition("graph").sortWithinPartitions("graph", "ord", "s").select("graph", "text").write.partitionBy("graph").text(path, lineSep="\n\n")


def write_trig(t: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """TriG in one file: prefixes, then a block for each graph, its subjects in order. Each line of the file is a row, so no block is held whole."""
    prefixes = PREFIXES if prefixes is None else prefixes
    own = statements(_with_ontology(t), prefixes).select("ng", "ord", "s", "text")
    g = t.select("ng").distinct()
    opened = g.select("ng", F.lit(-1).alias("ord"), F.lit("").alias("s"), F.concat(F.lit("<"), "ng", F.lit("> {")).alias("text"))
    closed = g.select("ng", F.lit(2).alias("ord"), F.lit("").alias("s"), F.lit("}").alias("text"))
    head = t.sparkSession.range(1).select(F.lit("").alias("ng"), F.lit(-2).alias("ord"), F.lit("").alias("s"), F.lit(_header(prefixes)).alias("text"))
    every = own.unionByName(opened).unionByName(closed).unionByName(head if prefixes else head.where(F.lit(False)))
    every.coalesce(1).sortWithinPartitions("ng", "ord", "s").select("text").write.text(path, lineSep="\n")

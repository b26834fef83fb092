"""Validation against an ontology: findings as rows (ng, kind, rule, level, subject, predicate, object)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIRST, RDF, RDFS, TYPE, XSD
from .graphs import cyclic

COLUMNS = ["ng", "kind", "rule", "level", "subject", "predicate", "object"]


def _finding(df: DataFrame, kind: str, rule: object, level: str, s: Column, p: object = None, o: object = None) -> DataFrame:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return df.select("ng", F.lit(kind).alias("kind"), text(rule).alias("rule"), F.lit(level).alias("level"), s.alias("subject"), text(p).alias("predicate"), text(o).alias("object"))


def types(t: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes without rdf:type, and nodes none of whose types is a known class or property. One aggregate per node; lists are skipped."""
    known = elements.where("is_class or is_property").select(F.col("element").alias("o"), F.lit(True).alias("_known"))
    own = t.where(F.col("p") == TYPE).join(known, "o", "left").select("ng", "s", F.lit(1).alias("typed"), F.when(F.col("_known"), 1).otherwise(0).alias("good"), F.lit(0).alias("list"))
    rest = t.where(F.col("p") != TYPE).select("ng", "s", F.lit(0), F.lit(0), F.when(F.col("p") == FIRST, 1).otherwise(0))
    per = own.union(rest).groupBy("ng", "s").agg(*(F.max(c).alias(c) for c in ("typed", "good", "list"))).where("list = 0 and good = 0 and s <> ng")
    return _finding(per, "RdfType", F.when(F.col("typed") == 0, "RdfType_missing").otherwise("RdfType_wrong"), "error", F.col("s"), TYPE)


def literal_fits(rng: Column, dtype: Column, lang: Column) -> Column:
    """Whether a literal fits a range; datatypes compare by IRI, and a language makes it rdf:langString."""
    real = F.when(lang.isNotNull(), RDF + "langString").otherwise(F.coalesce(dtype, F.lit(XSD + "string")))
    return (rng == RDFS + "Literal") | (rng == real)


def domain_and_range(t: DataFrame, elements: DataFrame, inherited: DataFrame, kinds: DataFrame) -> DataFrame:
    """Unknown predicates, predicates that are no property, subjects outside the domain, objects outside the range.

    The ontology's tables are broadcast, as they grow with the vocabulary; data never is, whatever a compressed file's size makes of it:
    inner joins with tables of unknown size would else build on the data's side."""
    own = t.where(~F.col("p").isin(TYPE, FIRST))
    el = elements.select(F.col("element").alias("p"), "is_property")
    inh = inherited.select(F.col("element").alias("p"), "domain", "range")
    joined = own.join(F.broadcast(el), "p", "left").join(F.broadcast(inh), "p", "left")
    unknown = _finding(joined.where("is_property is null"), "DomainAndRange", "predicate_unknown", "warning", F.col("s"), F.col("p"))
    wrong = _finding(joined.where("not is_property"), "DomainAndRange", "predicate_not_property", "error", F.col("s"), F.col("p"))
    node_kinds = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("sub")).join(kinds.select("sub", "kind"), "sub", "left").select("s", F.coalesce("kind", "sub").alias("kind"))
    node_kinds = node_kinds.union(t.where(F.col("p") == TYPE).select("s", "o")).distinct()
    fine = lambda node, cls: node_kinds.select(F.col("s").alias(node), F.col("kind").alias(cls)).hint("merge")
    # a node of another graph that isn't here can't be judged
    here = t.where(F.col("p") == TYPE).select(F.col("s").alias("o")).distinct().hint("merge")
    dom = joined.where("is_property and domain is not null").join(fine("s", "domain"), ["s", "domain"], "left_anti")
    dom = _finding(dom, "DomainAndRange", "domain_mismatch", "error", F.col("s"), F.col("p"))
    rng = joined.where("is_property and range is not null")
    node = rng.where("o_kind = 'node'").join(here, "o", "left_semi").join(fine("o", "range"), ["o", "range"], "left_anti")
    lit = rng.where("o_kind in ('lit', 'litcoll')").where(~literal_fits(F.col("range"), F.col("o_dtype"), F.col("o_lang")))
    bad = [_finding(x, "DomainAndRange", "range_mismatch", "error", F.col("s"), F.col("p"), F.col("o")) for x in (node, lit)]
    return unknown.unionByName(wrong).unionByName(dom).unionByName(bad[0]).unionByName(bad[1])


def functional(t: DataFrame, elements: DataFrame, kinds: DataFrame, inverse: bool = False) -> DataFrame:
    """Functional properties (or properties below one) with several values for a subject; one finding for each subject and
    functional property. With ``inverse``, several subjects for one object."""
    which, per = ("is_inverse_functional", "o") if inverse else ("is_functional", "s")
    top = elements.where(which).select(F.col("element").alias("kind"))
    under = kinds.join(top, "kind", "left_semi").select(F.col("sub").alias("p"), "kind").union(top.select(F.col("kind").alias("p"), "kind")).distinct()
    own = t.join(F.broadcast(under), "p").select("ng", "s", "o", F.col("kind").alias("f")).distinct()
    many = own.groupBy("ng", per, "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rule = "InverseFunctional_multiple" if inverse else "Functional_multiple"
    if inverse:
        return _finding(many, "InverseFunctionalProperty", rule, "error", F.lit(None).cast("string"), F.col("f"), F.col("o"))
    return _finding(many, "FunctionalProperty", rule, "error", F.col("s"), F.col("f"))


def valid_properties(t: DataFrame, kinds: DataFrame, known: DataFrame) -> DataFrame:
    """Properties defined in the data, with whether a known one (``known``: element) is above them."""
    own = t.where((F.col("p") == TYPE) & F.col("o").isin(f"{RDF}Property", "http://www.w3.org/2002/07/owl#ObjectProperty", "http://www.w3.org/2002/07/owl#DatatypeProperty")).select(F.col("s").alias("sub")).distinct()
    good = kinds.join(known.select(F.col("element").alias("kind")), "kind", "left_semi").select("sub").distinct().withColumn("_ok", F.lit(True))
    return own.join(good, "sub", "left").select(F.col("sub").alias("property"), F.coalesce("_ok", F.lit(False)).alias("valid"))


def classify(t: DataFrame, elements: DataFrame) -> DataFrame:
    """Per node: class, property or individual."""
    own = t.where(F.col("p") == TYPE).select(F.col("s").alias("element")).distinct()
    e = own.join(elements.select("element", "is_class", "is_property"), "element", "left")
    return e.select(F.col("element").alias("node"), F.when(F.col("is_class"), "class").when(F.col("is_property"), "property").otherwise("individual").alias("what"))


def report(*findings: DataFrame) -> DataFrame:
    """All findings of several checks."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("ng", "level").agg(F.count(F.lit(1)).alias("n"))


def passed(findings: DataFrame) -> DataFrame:
    """One row: whether no finding is an error."""
    return findings.agg((F.count(F.when(F.col("level") == "error", 1)) == 0).alias("passed"))


def acyclic(imports: DataFrame) -> DataFrame:
    """Graphs on a cycle of ``imports`` (a, b): graph, finding, level."""
    return cyclic(imports).select(F.col("node").alias("graph"), F.lit("ImportCycle").alias("finding"), F.lit("error").alias("level"))

"""Ontologies as tables: flags, inherited domains and ranges, subsumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import OWL, RDF, RDFS, TYPE
from .graphs import closure

SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, INVERSE = f"{RDFS}subClassOf", f"{RDFS}subPropertyOf", f"{RDFS}domain", f"{RDFS}range", f"{OWL}inverseOf"
CLASSES = (f"{RDFS}Class", f"{OWL}Class")
PROPERTIES = (f"{RDF}Property", f"{OWL}ObjectProperty", f"{OWL}DatatypeProperty", f"{OWL}FunctionalProperty", f"{OWL}InverseFunctionalProperty")


def kinds(t: DataFrame) -> DataFrame:
    """(sub, kind, depth): subsumption of classes and properties, reflexive and transitive."""
    edges = t.where(F.col("p").isin(SUB_CLASS, SUB_PROPERTY)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    every = edges.select("a").union(edges.select("b")).distinct()
    return closure(edges).where("a <> b").union(every.select("a", F.col("a").alias("b"), F.lit(0))).toDF("sub", "kind", "depth")


def elements(t: DataFrame) -> DataFrame:
    """Per element: is_class, is_property, is_functional, is_inverse_functional, own domain, range and inverse. One aggregate."""
    has = lambda *o: F.coalesce(F.max(F.when((F.col("p") == TYPE) & F.col("o").isin(*o), True)), F.lit(False))
    own = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    return t.groupBy(F.col("s").alias("element")).agg(
        has(*CLASSES).alias("is_class"), has(*PROPERTIES).alias("is_property"),
        has(f"{OWL}FunctionalProperty").alias("is_functional"), has(f"{OWL}InverseFunctionalProperty").alias("is_inverse_functional"),
        own(DOMAIN).alias("domain"), own(RANGE).alias("range"), own(INVERSE).alias("inverse_of"),
    )


def inherited(elements_: DataFrame, kinds_: DataFrame) -> DataFrame:
    """Each property's domain and range, from the nearest property above it that states one; ties to the least."""
    up = kinds_.join(elements_.where("is_property").select(F.col("element").alias("kind"), "domain", "range"), "kind")
    nearest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("depth", c)))[c]
    return up.groupBy(F.col("sub").alias("element")).agg(nearest("domain").alias("domain"), nearest("range").alias("range"))


def symmetric_inverse(elements_: DataFrame) -> DataFrame:
    """inverse_of in both directions, and domain and range filled in from the inverse."""
    pairs = elements_.where("inverse_of is not null").select("element", "inverse_of")
    both = pairs.union(pairs.select("inverse_of", "element")).groupBy("element").agg(F.min("inverse_of").alias("inv"))
    other = elements_.select(F.col("element").alias("inv"), F.col("domain").alias("_d"), F.col("range").alias("_r"))
    out = elements_.drop("inverse_of").join(both, "element", "left").join(other, "inv", "left")
    return out.select("element", F.col("inv").alias("inverse_of"), F.coalesce("domain", "_r").alias("domain"), F.coalesce("range", "_d").alias("range"))


def of_kind(t: DataFrame, kinds_: DataFrame, kind: str) -> DataFrame:
    """Nodes with a type that is ``kind`` or below it."""
    below = kinds_.where(F.col("kind") == kind).select(F.col("sub").alias("o"))
    return t.where(F.col("p") == TYPE).join(below, "o", "left_semi").select("ng", F.col("s").alias("node")).distinct()


def main_types(t: DataFrame, kinds_: DataFrame, main: DataFrame) -> DataFrame:
    """Per node the most special of its types among ``main`` (cls): one that no other of its types is below; ties to the least."""
    types = t.where(F.col("p") == TYPE).select("ng", "s", F.col("o").alias("cls")).join(main, "cls", "left_semi")
    above = types.join(kinds_.where("depth > 0").select(F.col("sub").alias("cls"), F.col("kind").alias("up")), "cls").select("ng", "s", F.col("up").alias("cls")).distinct()
    return types.join(above, ["ng", "s", "cls"], "left_anti").groupBy("ng", "s").agg(F.min("cls").alias("main_type"))


def depth_order(kinds_: DataFrame) -> DataFrame:
    """Elements by their distance from the farthest root."""
    return kinds_.groupBy("sub").agg(F.max("depth").alias("level"))


def known(t: DataFrame, elements_: DataFrame) -> DataFrame:
    """Predicates and types in use, with whether the ontology has them."""
    used = t.select(F.col("p").alias("element")).union(t.where(F.col("p") == TYPE).select("o")).distinct()
    return used.join(elements_.select("element", F.lit(True).alias("_k")), "element", "left").select("element", F.coalesce("_k", F.lit(False)).alias("known"))


def additional_types(t: DataFrame, known_: DataFrame) -> DataFrame:
    """(ng, node, cls): the types of nodes that the ontology (``known_``: element) doesn't have, and those above them that any graph states."""
    own = t.where(F.col("p") == TYPE).select("ng", F.col("s").alias("node"), F.col("o").alias("cls"))
    out = own.join(known_.select(F.col("element").alias("cls")), "cls", "left_anti")
    above = closure(t.where(F.col("p") == SUB_CLASS).select(F.col("s").alias("a"), F.col("o").alias("b")))
    return out.select("ng", "node", "cls").union(out.join(above.withColumnRenamed("a", "cls"), "cls").select("ng", "node", "b")).distinct()


def inverse_sub_properties(elements_: DataFrame, kinds_: DataFrame) -> DataFrame:
    """(sub, kind): where p is below q and both have an inverse, p's inverse is below q's."""
    inv = symmetric_inverse(elements_).where("inverse_of is not null").select("element", "inverse_of")
    both = kinds_.where("depth > 0").join(inv.select(F.col("element").alias("sub"), F.col("inverse_of").alias("i")), "sub").join(inv.select(F.col("element").alias("kind"), F.col("inverse_of").alias("j")), "kind")
    return both.where("i <> j").select(F.col("i").alias("sub"), F.col("j").alias("kind")).distinct()


def about(t: DataFrame) -> DataFrame:
    """What an ontology says of its elements for people: element, label, comment, defined_by, and how many elements are directly below."""
    own = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    said = t.groupBy(F.col("s").alias("element")).agg(own(f"{RDFS}label").alias("label"), own(f"{RDFS}comment").alias("comment"), own(f"{RDFS}isDefinedBy").alias("defined_by"))
    below = t.where(F.col("p").isin(SUB_CLASS, SUB_PROPERTY)).groupBy(F.col("o").alias("element")).agg(F.count_distinct("s").alias("below"))
    return said.join(below, "element", "left").withColumn("below", F.coalesce("below", F.lit(0)))


def class_flags(t: DataFrame, kinds_: DataFrame) -> DataFrame:
    """Per class: is_root (nothing above it), is_leaf (nothing below it), is_abstract (no node has it as a type of its own)."""
    classes = t.where((F.col("p") == TYPE) & F.col("o").isin(*CLASSES)).select(F.col("s").alias("cls")).distinct()
    edge = kinds_.where("depth = 1")
    flag = lambda df, c: df.select(F.col(c).alias("cls")).distinct().withColumn(f"_{c}", F.lit(True))
    used = t.where(F.col("p") == TYPE).withColumnRenamed("o", "used")
    out = classes.join(flag(edge, "sub"), "cls", "left").join(flag(edge, "kind"), "cls", "left").join(flag(used, "used"), "cls", "left")
    return out.select("cls", F.col("_sub").isNull().alias("is_root"), F.col("_kind").isNull().alias("is_leaf"), F.col("_used").isNull().alias("is_abstract"))

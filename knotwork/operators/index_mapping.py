"""How fields of search documents are analysed and kept, by document type; and the tokens that follow from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import phrase_token, separated_token
from .search import tokens

#: Document types that have fields beyond the common ones, and the type of everything else.
TYPES = (
    "GenericPart", "Organization", "RepresentationContext", "ShapeFeatureDefinition", "ClassificationSystem", "ClassSystem", "Person",
    "ProductClass", "MaterializedPhysicalObject", "ComputerFile", "BreakdownSystem", "ProductFamily", "Document",
)
DEFAULT = "-"


@dataclass(frozen=True)
class Field:
    """analyzer: keyword (whole), phrase (whole, lower case), separated (one token), text (words) or number."""

    analyzer: str
    indexed: bool = True
    stored: bool = True
    sortable: bool = False


_KEY, _PHRASE, _SEPARATED, _TEXT = Field("keyword"), Field("phrase", stored=False, sortable=True), Field("separated", stored=False), Field("text")
#: Fields of every document; of every recognised type; and of one type alone.
COMMON = {"mainType": _KEY, "directImport": _KEY, "graphID": _KEY, "graphURI": _KEY, "nodeCount": Field("number", sortable=True), "literal": _TEXT}
LABELLED = {"label": _TEXT, "label.phrase": _PHRASE}
NAMED = {
    "additionalType": _TEXT, "mainNode": _KEY, **LABELLED, "id": Field("keyword", sortable=True), "id.key": _SEPARATED, "id.phrase": _PHRASE, "id.type": _KEY, "id.sort": _KEY,
    "id.idOwner": _TEXT, "id.idOwner.key": _SEPARATED, **{f"id.idOwner.{k}": v for k, v in LABELLED.items()}, "id.idOwner.uri": _KEY,
    "id.idOwner.uri.graph": Field("keyword", indexed=False), "id.idOwner.uri.fragment": Field("keyword", indexed=False),
}
COMMIT = {k: _KEY for k in ("commitHash", "commitAuthor", "commitTime", "commitMessage", "specificType")}
OWN = {"GenericPart": {"part.partCategory": _KEY}, "ShapeFeatureDefinition": {"shapeFeatureType": _KEY, "shapeFeatureSubClass": _KEY}}


def fields(kind: str) -> dict[str, Field]:
    """The fields of a document type."""
    if kind not in TYPES:
        return dict(COMMON)
    return COMMON | NAMED | {f"definedBy.{k}": v for k, v in NAMED.items()} | COMMIT | OWN.get(kind, {})


def mapping(spark) -> DataFrame:
    """All of it as a table: type, field, analyzer, indexed, stored, sortable."""
    rows = [(t, n, f.analyzer, f.indexed, f.stored, f.sortable) for t in (DEFAULT, *TYPES) for n, f in fields(t).items()]
    return spark.createDataFrame(rows, "type string, field string, analyzer string, indexed boolean, stored boolean, sortable boolean")


def analysed(c: Column, analyzer: str) -> Column:
    """The terms that a value is found by."""
    if analyzer == "text":
        return tokens(c)
    return F.array({"keyword": c, "phrase": phrase_token(c), "separated": separated_token(c), "number": c}[analyzer].cast("string"))


def terms(documents: DataFrame, kind: str) -> DataFrame:
    """The inverted index of ``documents`` (graph_uri, fields: map of a field's name to its values): graph_uri, field, term."""
    f, out = fields(kind), None
    each = documents.select("graph_uri", F.explode("fields").alias("field", "values")).select("graph_uri", "field", F.explode("values").alias("value"))
    for analyzer in ("keyword", "phrase", "separated", "text", "number"):
        names = [n for n, x in f.items() if x.analyzer == analyzer and x.indexed]
        own = each.where(F.col("field").isin(*names)).select("graph_uri", "field", F.explode(analysed(F.col("value"), analyzer)).alias("term"))
        out = own if out is None else out.union(own)
    return out.where("term <> ''").distinct()

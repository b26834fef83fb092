"""Industrial formats to triples and back: exchange files by attribute order, XML by references, shapes by points.

Positions, references and coordinates are joined, never looked up in a driver's table; only ontologies and unit
tables are small enough to be broadcast, and Spark decides that from their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import path_commands, points, short_number
from ..model import EX, SCHEMA_NS, TYPE, XSD

# exchange files


def attribute_order(ontology: DataFrame, kinds: DataFrame) -> DataFrame:
    """(entity, pos, p): the place of every attribute in an entity's values, those of entities above it first.

    ``ontology``: entity, n (its own attributes' order), p; ``kinds``: sub, kind, depth, reflexive."""
    every = kinds.join(ontology.withColumnRenamed("entity", "kind"), "kind").select(F.col("sub").alias("entity"), "depth", "kind", "n", "p")
    w = Window.partitionBy("entity").orderBy(F.desc("depth"), "kind", "n")
    return every.select("entity", (F.row_number().over(w) - 1).alias("pos"), "p")


def attribute_values(instances: DataFrame) -> DataFrame:
    """(file, id, entity, pos, idx, kind, value): the values of instances; members of a list have their place as idx.

    Kinds: ref, string, integer, double, enum, typed; unset and derived values give no row."""
    one = instances.where("entity is not null").select("file", "id", "entity", F.posexplode("args").alias("pos", "v"))
    listed = F.col("v").startswith("(")
    inner = F.regexp_extract_all("v", F.lit(r"('(?:[^']|'')*'|[^,()]+(?:\([^()]*\))?)"), 1)
    one = one.withColumn("vs", F.when(listed, inner).otherwise(F.array("v")))
    many = one.select("file", "id", "entity", "pos", F.when(listed, F.lit(1)).alias("l"), F.posexplode("vs").alias("i", "v"))
    v = F.trim("v")
    kind = (
        F.when(v.startswith("#"), "ref").when(v.startswith("'"), "string").when(v.startswith("."), "enum").when(v.rlike("^[-+]?[0-9]+$"), "integer")
        .when(v.rlike("^[-+]?[0-9]"), "double").when(v.rlike("^[A-Za-z]"), "typed")
    )
    text = F.replace(F.regexp_extract(v, "^'((?s).*)'$", 1), F.lit("''"), F.lit("'"))
    value = F.when(kind == "string", text).when(kind == "enum", F.regexp_replace(v, r"^\.|\.$", "")).when(kind == "ref", F.substring(v, 2, 20)).otherwise(v)
    return many.where(kind.isNotNull()).select("file", "id", "entity", "pos", F.when(F.col("l").isNotNull(), F.col("i")).alias("idx"), kind.alias("kind"), value.alias("value"))


def instance_triples(instances: DataFrame, order: DataFrame, classes: DataFrame) -> DataFrame:
    """Triples of instances: values meet ``order`` (entity, pos, p) by entity and position, types ``classes`` (entity, cls)."""
    node = lambda c: F.concat("file", F.lit("#"), c.cast("string"))
    types = instances.join(classes, "entity").select(F.col("file").alias("ng"), node(F.col("id")).alias("s"), F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), F.col("cls").alias("o"), F.lit(None).cast("string").alias("o_dtype"), F.lit(None).cast("int").alias("member_idx"))
    v = attribute_values(instances).join(order, ["entity", "pos"])
    ref = F.col("kind") == "ref"
    dtype = F.when(ref, None).otherwise(F.concat(F.lit(XSD), F.when(F.col("kind").isin("integer", "double"), F.col("kind")).otherwise("string")))
    own = v.select(F.col("file").alias("ng"), node(F.col("id")).alias("s"), "p", F.when(ref, "node").otherwise("lit").alias("o_kind"), F.when(ref, node(F.col("value"))).otherwise(F.col("value")).alias("o"), dtype.alias("o_dtype"), F.col("idx").alias("member_idx"))
    return types.unionByName(own).dropDuplicates(["ng", "s", "p", "o_kind", "o", "o_dtype", "member_idx"])


def without_scaffolding(t: DataFrame, classes: DataFrame) -> DataFrame:
    """``t`` without the nodes of some types (cls), and without what refers to them."""
    gone = t.where(F.col("p") == TYPE).join(classes.select(F.col("cls").alias("o")), "o", "left_semi").select(F.col("s").alias("_n")).distinct()
    rest = t.join(gone.withColumnRenamed("_n", "s"), "s", "left_anti")
    refs = rest.where("o_kind = 'node'").join(gone.withColumnRenamed("_n", "o"), "o", "left_anti")
    return rest.where("o_kind <> 'node'").unionByName(refs.select(*rest.columns)).select(*t.columns)


def in_base_units(t: DataFrame, value: str, unit: str, units: DataFrame, into: str) -> DataFrame:
    """Measures as one value in base units: per node its ``value`` (a predicate) times the factor of its ``unit`` (a predicate) in
    ``units`` (unit, factor, base): ng, s, p (``into``), o, base. A unit that isn't known keeps the number and has no base."""
    v = t.where(F.col("p") == value).select("ng", "s", F.col("o").try_cast("double").alias("v"))
    u = t.where(F.col("p") == unit).select("ng", "s", F.col("o").alias("unit"))
    both = v.join(u, ["ng", "s"]).join(units, "unit", "left")
    return both.select("ng", "s", F.lit(into).alias("p"), short_number(F.col("v") * F.coalesce("factor", F.lit(1.0))).alias("o"), "base")


def expanded(t: DataFrame, templates: DataFrame) -> DataFrame:
    """Nodes of combined types as several nodes: ``templates`` (cls, role, role_cls, link) say which nodes stand for one of ``cls``, and by
    which predicate the first is linked to them. The new nodes are named after the old one and their role."""
    own = t.where(F.col("p") == TYPE).join(templates.withColumnRenamed("cls", "o"), "o").select("ng", "s", "role", "role_cls", "link")
    node = F.concat("s", F.lit("/"), "role")
    made = own.select("ng", node.alias("s"), F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), F.col("role_cls").alias("o"))
    links = own.select("ng", "s", F.col("link").alias("p"), F.lit("node").alias("o_kind"), node.alias("o"))
    return t.unionByName(made, allowMissingColumns=True).unionByName(links, allowMissingColumns=True)


# XML with references


def xml_nodes(elements: DataFrame) -> DataFrame:
    """(file, id, node, parent): the node that each element stands for, by its uid, or else by file and place."""
    uid = F.col("attrs")["uid"]
    return elements.where("id is not null").select("file", "id", F.coalesce(F.concat(F.col("file"), F.lit("#"), uid), F.concat(F.lit("_:"), F.col("file"), F.lit("-"), F.col("id").cast("string"))).alias("node"), "parent")


def xml_triples(elements: DataFrame) -> DataFrame:
    """Triples of XML elements, in two passes: elements become nodes, then references find theirs by uid.

    An element with a text and nothing in it is a literal of its parent; one with a uidRef refers to the node of that uid; any other
    is a node of its own. References to a uid that no element has stay out: ``unresolved`` lists them."""
    e = elements.where("id is not null")
    nodes = xml_nodes(e)
    inner = e.select("file", F.col("parent").alias("id")).distinct().withColumn("_inner", F.lit(True))
    e = e.join(inner, ["file", "id"], "left").join(nodes.select("file", "id", "node"), ["file", "id"])
    ref, p = F.col("attrs")["uidRef"], F.concat(F.lit(SCHEMA_NS), "tag")
    leaf = F.col("_inner").isNull() & F.col("text").isNotNull() & F.col("attrs")["uid"].isNull()
    above = nodes.select("file", F.col("id").alias("parent"), F.col("node").alias("s"))
    held = e.join(above, ["file", "parent"], "left")
    ng = F.concat(F.lit(EX), "file").alias("ng")
    types = e.where(ref.isNull() & ~leaf).select(ng, F.col("node").alias("s"), F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), p.alias("o"))
    literals = held.where(leaf & F.col("s").isNotNull()).select(ng, "s", p.alias("p"), F.lit("lit").alias("o_kind"), F.col("text").alias("o"))
    parts = held.where(ref.isNull() & ~leaf & F.col("s").isNotNull()).select(ng, "s", p.alias("p"), F.lit("node").alias("o_kind"), F.col("node").alias("o"))
    of = e.where(F.col("attrs")["uid"].isNotNull()).select("file", F.col("attrs")["uid"].alias("_ref"), F.col("node").alias("_to"))
    refs = held.where(ref.isNotNull()).withColumn("_ref", ref).join(of, ["file", "_ref"]).select(ng, "s", p.alias("p"), F.lit("node").alias("o_kind"), F.col("_to").alias("o"))
    return types.unionByName(literals).unionByName(parts).unionByName(refs)


def unresolved(elements: DataFrame) -> DataFrame:
    """(file, uid): references to a uid that no element of the file has."""
    e = elements.where("id is not null")
    uids = e.select("file", F.col("attrs")["uid"].alias("uid")).where("uid is not null")
    return e.select("file", F.col("attrs")["uidRef"].alias("uid")).where("uid is not null").join(uids, ["file", "uid"], "left_anti").distinct()


def nested(t: DataFrame, cls: str, depth: int = 2) -> DataFrame:
    """(ng, s, document): nodes of a type as JSON, their objects nested to a depth, below that by name. A join per level."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))  # noqa: E731  a JSON string with {"v": and } around it
    text = F.regexp_replace(quoted(F.col("o")), r'^\{"v":(.*)\}$', "$1")
    docs = None
    for _ in range(depth):
        own = t.select("ng", "s", "p", "o_kind", "o", text.alias("j"))
        if docs is not None:
            inner = docs.select("ng", F.col("s").alias("o"), F.col("document").alias("_d"))
            own = own.join(inner, ["ng", "o"], "left").withColumn("j", F.when((F.col("o_kind") == "node") & F.col("_d").isNotNull(), F.col("_d")).otherwise(F.col("j")))
        per = own.groupBy("ng", "s", "p").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("js"))
        entry = F.concat(F.lit('"'), "p", F.lit('":'), "js")
        docs = per.groupBy("ng", "s").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("document"))
    roots = t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("ng", "s").distinct()
    return docs.join(roots, ["ng", "s"], "left_semi")


# shapes


def shapes(elements: DataFrame) -> DataFrame:
    """(file, id, kind, pts, style): SVG shapes with their points in order; a path's are the ends of its absolute commands. A shape
    takes the style of the group around it where it has none."""
    a = F.col("attrs")
    of = lambda *ks: [F.coalesce(a[k].try_cast("double"), F.lit(0.0)) for k in ks]
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = of("x1", "y1", "x2", "y2")
    x, y, w, h = of("x", "y", "width", "height")
    cx, cy, r, rx, ry = of("cx", "cy", "r", "rx", "ry")
    ends = F.transform(F.filter(path_commands(a["d"]), lambda c: c["command"].isin("M", "L", "C", "S", "Q", "T", "A") & (F.size(c["args"]) >= 2)), lambda c: at(F.element_at(c["args"], -2), F.element_at(c["args"], -1)))
    pts = (
        F.when(F.col("tag") == "line", F.array(at(x1, y1), at(x2, y2)))
        .when(F.col("tag") == "rect", F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)))
        .when(F.col("tag") == "circle", F.array(at(cx, cy), at(cx + r, cy)))
        .when(F.col("tag") == "ellipse", F.array(at(cx, cy), at(cx + rx, cy), at(cx, cy + ry)))
        .when(F.col("tag").isin("polyline", "polygon"), points(a["points"]))
        .when(F.col("tag") == "path", ends)
    )
    groups = elements.where("tag = 'g'").select("file", F.col("id").alias("parent"), a["style"].alias("_style"))
    own = elements.where(pts.isNotNull()).select("file", "id", "parent", F.col("tag").alias("kind"), pts.alias("pts"), a["style"].alias("style"))
    return own.join(groups, ["file", "parent"], "left").select("file", "id", "kind", "pts", F.coalesce(F.nullif("style", F.lit("")), "_style").alias("style"))


def shape_triples(shapes_: DataFrame) -> DataFrame:
    """Triples of shapes: each lists its points in order, and equal points of a file are one node, named by their coordinates."""
    ng = F.concat(F.lit(EX), "file").alias("ng")
    s = F.concat(F.lit("#shape"), F.col("id").cast("string")).alias("s")
    each = shapes_.select(ng, s, "kind", "style", F.posexplode("pts").alias("i", "pt"))
    x, y = short_number(F.col("pt.x")), short_number(F.col("pt.y"))
    name = F.concat(F.lit("#point"), x, F.lit(","), y)
    none, text = F.lit(None).cast("int").alias("member_idx"), lambda k: F.lit(XSD + k).alias("o_dtype")
    node = F.lit(None).cast("string").alias("o_dtype")
    types = shapes_.select(ng, s, F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), F.concat(F.lit(SCHEMA_NS), "kind").alias("o"), node, none)
    styles = shapes_.where("style is not null").select(ng, s, F.lit(f"{SCHEMA_NS}style").alias("p"), F.lit("lit").alias("o_kind"), F.col("style").alias("o"), text("string"), none)
    members = each.select("ng", "s", F.lit(f"{SCHEMA_NS}point").alias("p"), F.lit("node").alias("o_kind"), name.alias("o"), node, F.col("i").alias("member_idx"))
    coords = each.select("ng", name.alias("s"), F.explode(F.create_map(F.lit("x"), x, F.lit("y"), y)).alias("k", "o")).distinct()
    coords = coords.select("ng", "s", F.concat(F.lit(SCHEMA_NS), "k").alias("p"), F.lit("lit").alias("o_kind"), "o", text("double"), none)
    return types.unionByName(styles).unionByName(members).unionByName(coords)


def shape_attributes(t: DataFrame) -> DataFrame:
    """(ng, s, attrs): shapes as maps of what an SVG writer needs: kind, style, points; the y axis points down there, so it is negated."""
    of = lambda k, name: t.where(F.col("p") == f"{SCHEMA_NS}{k}").select("ng", F.col("s").alias("o"), F.col("o").cast("double").alias(name))
    at = t.where(F.col("p") == f"{SCHEMA_NS}point").select("ng", "s", "o", "member_idx").join(of("x", "x"), ["ng", "o"]).join(of("y", "y"), ["ng", "o"])
    one = F.concat(short_number(F.col("x")), F.lit(","), short_number(-F.col("y")))
    pts = at.groupBy("ng", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_idx", one.alias("t")))), lambda v: v["t"]), " ").alias("points"))
    about = t.groupBy("ng", "s").agg(
        F.max(F.when(F.col("p") == TYPE, F.substring_index("o", "#", -1))).alias("kind"), F.max(F.when(F.col("p") == f"{SCHEMA_NS}style", F.col("o"))).alias("style"),
    )
    both = pts.join(about, ["ng", "s"])
    return both.select("ng", "s", F.map_filter(F.create_map(F.lit("kind"), "kind", F.lit("style"), "style", F.lit("points"), "points"), lambda k, v: v.isNotNull()).alias("attrs"))



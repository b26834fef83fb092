"""Scalar functions as column expressions; all but Base58, Base32 and escapes stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import XSD

#: The namespace of URL-named UUIDs, and the alphabet of Base58.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def iri_base(c: Column) -> Column:
    """What stands before the last #; all of an IRI without one."""
    return F.when(c.contains("#"), F.regexp_extract(c, "^(.*)#", 1)).otherwise(c)


def iri_fragment(c: Column) -> Column:
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(F.lit(""))


def is_iri(c: Column) -> Column:
    """Whether a trimmed value is an absolute IRI: a scheme, no space or bracket; a URN has a namespace and a name."""
    v = F.trim(c)
    plain = v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^\\s<>\"{}|\\\\^`]+$")
    return F.coalesce(plain & (~F.lower(v).startswith("urn:") | v.rlike("^[uU][rR][nN]:[A-Za-z0-9][A-Za-z0-9-]{1,31}:[^\\s]+$")), F.lit(False))


def split_prefix(c: Column) -> Column:
    """Up to and with the last / or #."""
    return F.regexp_extract(c, "^(.*[/#])([^/#]*)$", 1)


def split_suffix(c: Column) -> Column:
    return F.when(c.rlike("[/#]"), F.regexp_extract(c, "^(.*[/#])([^/#]*)$", 2)).otherwise(c)


def graph_id(c: Column) -> Column:
    """The UUID of a graph IRI: that of urn:uuid:, else the name-based one (SHA-1) of the IRI without a final #."""
    name = F.regexp_replace(c, "#$", "")
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), name.cast("binary")))
    digit = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(F.lower(c).startswith("urn:uuid:"), F.lower(F.substring(c, 10, 36))).otherwise(u)


def base58(raw: bytes, width: int = 44) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return out.rjust(width, BASE58[0])


def base58_decode(text: str, size: int = 32) -> bytes:
    n = 0
    for ch in text:
        n = n * 58 + BASE58.index(ch)
    return n.to_bytes(size, "big")


def base58_udf() -> object:
    """Base58 of binary values, by Arrow batches."""

    @F.pandas_udf("string")
    def encode(s):
        return s.map(lambda b: None if b is None else base58(bytes(b)))

    return encode


def base58_decode_udf() -> object:
    """The binary values of Base58 texts, by Arrow batches."""

    @F.pandas_udf("binary")
    def decode(s):
        return s.map(lambda t: None if t is None else base58_decode(t))

    return decode


def short_hash_range(prefix: str, alphabet: str = BASE58, width: int = 44) -> tuple[str, str]:
    """The least and greatest hash of ``width`` characters with a prefix."""
    return prefix.ljust(width, alphabet[0]), prefix.ljust(width, alphabet[-1])


#: The alphabet of Base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_: Column) -> Column:
    """Base32 without padding of a value given in hex digits, ten of which make eight digits."""
    bits = F.array_join(F.transform(F.split(hex_, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    padded = F.rpad(bits, F.ceil(F.length(bits) / 5).cast("int") * 5, F.lit("0"))
    fives = F.transform(F.sequence(F.lit(0), (F.length(padded) / 5).cast("int") - 1), lambda i: F.conv(padded.substr(i * 5 + 1, F.lit(5)), 2, 10).cast("int"))
    return F.when(hex_ == "", "").otherwise(F.array_join(F.transform(fives, lambda i: F.lit(BASE32).substr(i + 1, F.lit(1))), ""))


def encoded(hex_: Column, how: str) -> Column:
    """A hash (hex digits) as hex, base64 or base32 text; for base58 see ``base58_udf``."""
    return {"hex": F.lower(hex_), "base64": F.base64(F.unhex(hex_)), "base32": base32(hex_)}[how]


def literal(value: Column, kind: str, lang: Column | None = None) -> Column:
    """A literal as (o, o_dtype, o_lang): of an XSD type, or ``langString`` with a language. Doubles have their shortest form."""
    if kind == "langString":
        return F.struct(value.cast("string").alias("o"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").alias("o_dtype"), lang.alias("o_lang"))
    text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss") if kind == "dateTime" else value.cast("string")
    return F.struct(text.alias("o"), F.lit(XSD + kind).alias("o_dtype"), F.lit(None).cast("string").alias("o_lang"))


def prefixed(base: Column, fragment: Column, prefix: Column, number: Column) -> Column:
    """prefix:fragment; a base without a prefix is called ns and its number."""
    return F.concat(F.coalesce(prefix, F.concat(F.lit("ns"), number.cast("string"))), F.lit(":"), fragment)


def display(o: Column, dtype: Column, lang: Column) -> Column:
    """A literal as people read it; doubles with two decimals."""
    return F.when(lang.isNotNull(), F.concat(F.lit('"'), o, F.lit('"@'), lang)).when(dtype == XSD + "double", F.format_string("%.2f", o.cast("double"))).when(dtype == XSD + "string", F.concat(F.lit('"'), o, F.lit('"'))).otherwise(o)


def canonical(kind: Column, o: Column, dtype: Column) -> Column:
    """The key under which objects are equal."""
    return F.when(kind == "node", F.concat(F.lit("<"), o, F.lit(">"))).otherwise(F.concat(F.lit('"'), o, F.lit('"^^<'), F.coalesce(dtype, F.lit("")), F.lit(">")))


def typed(o: Column, dtype: Column, kind: str) -> Column:
    """The value of a lexical form where it has a datatype and is valid, else null."""
    return F.when(dtype == XSD + kind, F.expr("null") if kind not in ("double", "integer", "boolean") else o.try_cast({"double": "double", "integer": "bigint", "boolean": "boolean"}[kind]))


def is_lang_tag(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z]+(-[A-Za-z0-9]+)*$"), F.lit(False))


def separated_token(c: Column) -> Column:
    """One lower-case token: outer separators dropped, inner ones a hyphen."""
    return F.lower(F.translate(F.regexp_replace(c, "^[-_/ ]+|[-_/ ]+$", ""), "_/ ", "---"))


def phrase_token(c: Column) -> Column:
    return F.lower(c)


def base64_url(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(c.cast("binary")), "\r?\n", ""), "+/", "-_")


def vault_path(digest: Column) -> Column:
    return F.concat(F.upper(F.substring(digest, 1, 2)), F.lit("/"), F.substring(digest, 3, 200))


def order_bytes(c: Column) -> Column:
    """A 64-bit number as 16 hex digits, those of its big-endian bytes in two's complement: negatives come after positives."""
    return F.lpad(F.hex(c.cast("bigint")), 16, "0")


def number_of_bytes(h: Column) -> Column:
    """The number whose ``order_bytes`` are given."""
    return F.conv(h, 16, -10).cast("bigint")


def value_bytes(c: Column) -> Column:
    """16 hex digits whose order is that of the numbers: the sign is turned round."""
    flipped = F.expr("shiftleft(1L, 63)").bitwiseXOR(c.cast("bigint"))
    return F.lpad(F.hex(flipped), 16, "0")


def floats(c: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(c), "\\s+"), lambda v: v != ""), lambda v: v.try_cast("double"))


def natural_key(c: Column) -> Column:
    """Digit runs padded to ten digits, so that text order is number order."""
    parts = F.regexp_extract_all(c, F.lit("(\\d+|\\D+)"), 1)
    pad = F.transform(parts, lambda t: F.when(t.rlike("^\\d") & (F.length(t) < 10), F.lpad(t, 10, "0")).otherwise(t))
    return F.array_join(pad, "")


#: What is written in capitals at a name's end or before a capital, and how.
INITIALISMS = {"Id": "ID", "Iri": "IRI", "Url": "URL", "Uri": "URI", "Uuid": "UUID", "Uid": "UID"}


def camel(c: Column) -> Column:
    """A fragment as an identifier: parts between hyphens start with a capital, only ASCII letters, digits and _ stay, and the first
    of each initialism is in capitals where no small letter or digit follows it."""
    parts = F.transform(F.split(c, "-"), lambda w: F.regexp_replace(w, "[^A-Za-z0-9_]", ""))
    out = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
    for word, capitals in INITIALISMS.items():
        out = F.regexp_replace(out, f"^((?:(?!{word}).)*){word}(?=[A-Z]|$)", f"$1{capitals}")
    return out


def arc_center(x1, y1, x2, y2, rx, ry, phi, large, sweep) -> tuple[Column, Column]:
    """The centre of an elliptic arc given by its end points."""
    c, s = F.cos(phi), F.sin(phi)
    dx, dy = (x1 - x2) / 2, (y1 - y2) / 2
    u, v = c * dx + s * dy, c * dy - s * dx
    grow = F.greatest(F.lit(1.0), F.sqrt(u * u / (rx * rx) + v * v / (ry * ry)))
    rx, ry = rx * grow, ry * grow
    under = F.greatest(F.lit(0.0), (rx * rx * ry * ry - rx * rx * v * v - ry * ry * u * u) / (rx * rx * v * v + ry * ry * u * u))
    k = F.sqrt(under) * F.when(large == sweep, -1.0).otherwise(1.0)
    a, b = k * rx * v / ry, -k * ry * u / rx
    return c * a - s * b + (x1 + x2) / 2, s * a + c * b + (y1 + y2) / 2


_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def points(c: Column) -> Column:
    """An SVG point list as an array of (x, y); an odd number at the end is left out."""
    v = numbers(c)
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(v))), lambda i: F.struct(F.get(v, i).alias("x"), F.get(v, i + 1).alias("y")))


def numbers(c: Column) -> Column:
    """All numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(_NUMBER), 0), lambda v: v.cast("double"))


def path_commands(c: Column) -> Column:
    """An SVG path as an array of (command, args)."""
    letters, rest = (F.regexp_extract_all(c, F.lit("([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)"), i) for i in (1, 2))
    return F.transform(F.arrays_zip(letters.alias("c"), rest.alias("a")), lambda x: F.struct(x["c"].alias("command"), numbers(x["a"]).alias("args")))


def short_number(c: Column) -> Column:
    """At most six decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), "\\.?0+$", ""), "^-0$", "0")


def path_text(*parts: Column | str) -> Column:
    """Path text: command letters as they are, numbers in short form, with a space between."""
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else short_number(p) for p in parts))


def arc_text(cx, cy, rx, ry, start, end) -> Column:
    """The path of an elliptic arc, anticlockwise from one angle (radians) to another; the large-arc flag is set beyond half a turn."""
    turn = 2 * 3.141592653589793
    span = F.pmod(end - start, F.lit(turn))
    x, y = (lambda a: cx + rx * F.cos(a)), (lambda a: cy + ry * F.sin(a))
    return path_text("M", x(start), y(start), "A", rx, ry, F.lit(0), (span > turn / 2).cast("int"), F.lit(1), x(end), y(end))


def affine(a: tuple, b: tuple) -> tuple:
    """The product of two affine maps (a b c d e f), columns or numbers."""
    return (
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3],
        a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    )


def inherit(child: Column, parent: Column) -> Column:
    return F.coalesce(F.nullif(child, F.lit("")), parent)


#: File extensions and media types.
MEDIA = {"ttl": "text/turtle", "trig": "application/trig", "xml": "application/xml", "json": "application/json", "txt": "text/plain", "html": "text/html", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "pdf": "application/pdf", "stp": "model/step", "csv": "text/csv", "zip": "application/zip"}


def extension(media: Column) -> Column:
    """A file extension for a media type; null where none is known."""
    known = F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in reversed(kv)))
    return known[F.lower(F.trim(F.substring_index(media, ";", 1)))]


def media_of_content(text: Column) -> Column:
    """A media type by how a text starts."""
    t = F.ltrim(text)
    low = F.lower(F.substring(t, 1, 64))
    return F.when(low.startswith("<!doctype html") | low.startswith("<html"), "text/html").when(low.startswith("<?xml"), F.when(F.lower(t).contains("<svg"), "image/svg+xml").otherwise("application/xml")).when(low.startswith("<svg"), "image/svg+xml").when(low.startswith("iso-10303-21"), "model/step").when(low.startswith("@prefix") | low.startswith("@base"), "text/turtle").when(low.startswith("{") | low.startswith("["), "application/json").when(low.startswith("%pdf"), "application/pdf").otherwise("text/plain")


def media_type(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv))
    return F.coalesce(known[F.lower(F.substring_index(name, ".", -1))], F.lit("application/octet-stream"))

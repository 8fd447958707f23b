"""Text functions: sentences, chunks, tolerant JSON, names, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_BLANKS = " \t\n\r\x0b\x0c"


def _trimmed(part: Column) -> Column:
    return F.btrim(part, F.lit(_BLANKS))


def sentences(text: Column) -> Column:
    """Parted after . ! ? and blanks; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), _trimmed), lambda s: s != "")


def chunks(text: Column, size: int = 4) -> Column:
    """array<struct<pos,text>>: up to ``size`` parts between full stops, joined by full stop and blank, with one at the end."""
    parts = F.filter(F.transform(F.split(text, r"\."), _trimmed), lambda s: s != "")
    n = F.ceil(F.size(parts) / size).cast("int")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.concat(F.array_join(F.slice(parts, i * size + 1, F.lit(size)), ". "), F.lit(".")).alias("text"))))


def json_body(text: Column) -> Column:
    """What stands between the outermost braces, code fences taken off; null without braces."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def tolerant_json(text: Column, schema: str) -> Column:
    """Parsed JSON, or null."""
    return F.from_json(json_body(text), schema)


def plain_name(name: Column) -> Column:
    """Without one leading title, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(name), r"(?i)^(?:dr|mr|ms|mrs)\.?\s+", "")))


def source_type(stem: Column) -> Column:
    """Kind of source by its file name; the first rule that fits counts."""
    s = F.lower(stem)
    has = lambda *words: [s.contains(w) for w in words]
    any_ = lambda c: c[0] if len(c) == 1 else c[0] | any_(c[1:])
    return (F.when(any_(has("cctv", "camera")), "cctv").when(any_(has("forensic", "report")), "forensic_report").when(any_(has("paramedic", "medical")), "medical_report")
            .when(any_(has("police", "officer")), "police_report").otherwise("statement"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def same_name(a: Column, b: Column, most: int = 2) -> Column:
    """Whether two names are equal or at most ``most`` letters apart, titles and case aside."""
    return F.levenshtein(plain_name(a), plain_name(b), most) >= 0

"""Scalar and collection helpers on text, versions, paths and SQL statements, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy of a string in bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c)))


def split_words(name: Column) -> Column:
    """Words of a camel- or snake-case name, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda w: w != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


_VERSION = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def version(text: Column) -> Column:
    """Struct that orders like the version: major, minor, patch, whether released, pre-release; null if it can't be read."""
    plain = F.trim(text)
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(plain, _VERSION, i), F.lit("")), F.lit("0")).try_cast("long")
    pre = F.regexp_extract(plain, _VERSION, 4)
    read = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("released"), pre.alias("pre"))
    return F.when(plain.rlike(_VERSION), read)


def version_gap(have: Column, latest: Column) -> Column:
    """none, patch, minor or major; null where either can't be read, none where the installed one is as new."""
    a, b = version(have), version(latest)
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(b <= a, F.lit("none"))
        .when(a["major"] != b["major"], F.lit("major"))
        .when(a["minor"] != b["minor"], F.lit("minor"))
        .otherwise(F.lit("patch"))
    )


def range_floor(declared: Column) -> Column:
    """The lower bound of a declared range: of its first branch's first comparator, also behind an alias."""
    first = F.trim(F.split(declared, r"\|\|")[0])
    body = F.split(F.trim(F.regexp_replace(first, r"^npm:(?:@[^/]+/)?[^@]+@", "")), r"\s+")[0]
    bare = F.regexp_replace(F.regexp_replace(body, r"^(?:[\^~]|>=?|=)?\s*", ""), r"\.[xX*]", ".0")
    return F.when(~((body == "") | (body == "*") | body.startswith("<")), version(bare))


def bare_identifier(raw: Column) -> Column:
    """A name without schema and quotes."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(raw), "[;,]$", ""), r"\."), -1)
    return F.regexp_replace(last, r"""^["'`\[]+|["'`\]]+$""", "")


def glob_to_regex(pattern: str) -> str:
    """`**` crosses directories, `*` and `?` don't."""
    out = []
    for part in re.findall(r"\*\*/?|\*|\?|[^*?]+", pattern):
        out.append("(?:.*/)?" if part == "**/" else ".*" if part == "**" else "[^/]*" if part == "*" else "[^/]" if part == "?" else re.escape(part))
    return "^" + "".join(out) + "$"


def path_parameters(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"[:{\[]([A-Za-z_][A-Za-z0-9_]*)[}\]]?"), 1)


def route_of_file(path: Column) -> Column:
    """Request path of a file by the app or pages convention, null for other files; groups and slots vanish, parameters stay as written."""
    app, pages = r"^(?:.*/)?app/(?!.*(?:^|/)pages/)(.*/)?[^/]*$", r"^(?:.*/)?pages/(.*)$"
    parts = F.filter(F.split(F.regexp_extract(path, app, 1), "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$") & ~p.startswith("@"))
    page = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, pages, 1), r"\.[cm]?[jt]sx?$", ""), r"(^|/)index$", "")
    in_app = path.rlike(r"(?:^|/)app/(?!.*(?:^|/)pages/)")
    served = F.when(in_app, path.rlike(r"(?:^|/)(?:route|page)\.[cm]?[jt]sx?$")).otherwise(path.rlike(pages) & path.rlike(r"\.[cm]?[jt]sx?$"))
    return F.when(served, F.concat(F.lit("/"), F.when(in_app, F.array_join(parts, "/")).otherwise(page)))


def shortened(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def duration_text(seconds: Column) -> Column:
    """+40s, +2m, +2m 30s."""
    minutes, rest = F.floor(seconds / 60), seconds % 60
    tail = F.when(rest > 0, F.concat(F.lit(" "), rest, F.lit("s"))).otherwise("")
    return F.when(seconds < 60, F.concat(F.lit("+"), seconds, F.lit("s"))).otherwise(F.concat(F.lit("+"), minutes, F.lit("m"), tail))

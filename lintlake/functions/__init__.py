"""Scalar expressions. Everything here is a Column in, Column out function that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def snippet_hash(text: Column) -> Column:
    return F.left(F.sha2(F.trim(text), 256), F.lit(16))


def value_hash(*parts: Column) -> Column:
    """Hash of a rule's values, joined by bars (nulls are left out)."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def hash31(text: Column) -> Column:
    """Signed 32-bit hash of a text: 31 times the hash so far plus the next UTF-16 unit; null stays null, empty is 0."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, u: F.pmod(h * 31 + u + (1 << 31), F.lit(1 << 32)) - (1 << 31))


def mask(text: Column, head: int, tail: int) -> Column:
    return F.concat(F.left(text, F.lit(head)), F.lit("***"), F.right(text, F.lit(tail)))


def major(version: Column) -> Column:
    """First number of a version after its range operators; null without one."""
    return F.regexp_extract(version, r"^[\^~>=<v ]*(\d+)", 1).try_cast("int")


def family(rule_id: Column) -> Column:
    return F.upper(F.substring_index(rule_id, "-", 1))


def grade(score: Column, cuts: list[tuple[int, str]], last: str) -> Column:
    """The letter of the first cut that the score reaches."""
    out = F.lit(last)
    for least, letter in reversed(cuts):
        out = F.when(score >= least, letter).otherwise(out)
    return out


#: Cut-offs of the four grade tables (fixed values).
GRADES = {
    "ip": ([(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F"),
    "audit": ([(95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D")], "F"),
    "structure": ([(90, "A"), (75, "B"), (60, "C"), (40, "D")], "F"),
    "share": ([(90, "S"), (80, "A"), (70, "B"), (60, "C")], "D"),
}


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters; null and empty give 0. Characters are summed in code point order."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.size(chars)
    shares = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda d: d == c)) / size)
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def normalize_path(path: Column) -> Column:
    """Resolve `.` and `..` segments; `..` at the root is dropped."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(folded, "/")


def purl(kind: str, name: Column, version: Column) -> Column:
    """Package URL; the @ of a scope is percent-encoded."""
    return F.concat(F.lit(f"pkg:{kind}/"), F.regexp_replace(name, "^@", "%40"), F.lit("@"), version)


def branch_slug(message: Column, most: int = 40) -> Column:
    """Lower-case words of a message joined by dashes, cut to `most` characters without a dash at either end."""
    slug = F.regexp_replace(F.lower(message), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(slug, "^-|-$", ""), F.lit(most)), "-$", "")


def heal(text: Column) -> Column:
    """Safe rewrites of a source text: loose equality, var, trailing blanks and runs of blank lines."""
    out = F.regexp_replace(text, r"([^=!<>])==([^=])", "$1===$2")
    out = F.regexp_replace(out, r"!=([^=])", "!==$1")
    out = F.regexp_replace(out, r"\bvar\s+", "let ")
    out = F.regexp_replace(out, r"[ \t]+(\n|$)", "$1")
    return F.regexp_replace(out, r"\n{4,}", "\n\n\n")

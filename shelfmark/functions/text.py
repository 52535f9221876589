"""Scalar functions on store paths, file paths and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """Text after the last slash; all of it without one, empty after a trailing one."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - F.when(path.contains("/"), 1).otherwise(0))


def parse_store_path(path: Column) -> Column:
    """struct(dir, hash, name) of ``dir/hash-name``; null without a dash in the last component."""
    last = basename(path)
    at = F.instr(last, "-")
    parsed = F.struct(
        dirname(path).alias("dir"),
        F.substring(last, F.lit(1), at - 1).alias("hash"),
        F.substring(last, at + 1, F.length(last)).alias("name"),
    )
    return F.when(at > 0, parsed)


def store_path(store_dir: Column, hash_: Column, name: Column) -> Column:
    return F.concat(store_dir, F.lit("/"), hash_, F.lit("-"), name)


def label(attr: Column, output: Column) -> Column:
    return F.concat(attr, F.lit("."), output)


def shown_label(attr: Column, output: Column, toplevel: Column) -> Column:
    """The label, in parentheses if the package is not a top-level one."""
    return F.when(toplevel, label(attr, output)).otherwise(F.concat(F.lit("("), label(attr, output), F.lit(")")))


def grouped(n: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(n, 0)


def text_line(attr: Column, size: Column, kind: Column, path: Column) -> Column:
    """Label padded to 40 on the right, size to 14 on the left (neither is cut), kind and path."""
    wide = F.rpad(attr, F.greatest(F.lit(40), F.length(attr)), F.lit(" "))
    number = F.lpad(grouped(size), F.greatest(F.lit(14), F.length(grouped(size))), F.lit(" "))
    return F.concat_ws(" ", wide, number, kind, path)


def highlighted(path: Column, pattern: str) -> Column:
    """Marks all matches of a (Java) pattern with terminal colour codes; empty matches stay."""
    return F.regexp_replace(path, f"((?=[\\s\\S])(?:{pattern}))(?<!^$)", "\x1b[31m$1\x1b[0m")


def trigrams(text: Column) -> Column:
    """Distinct three-byte grams in upper-case hexadecimal; none if shorter."""
    raw = text.cast("binary")
    n = F.octet_length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.hex(F.substring(raw, i, F.lit(3))))
    return F.when(n >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def percent_encoded(value: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``-._~``."""
    out = F.url_encode(value)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cache_digest(header: Column) -> Column:
    """A digest of a version token; without one the word ``unknown`` as it is."""
    return F.coalesce(F.sha2(header, 256), F.lit("unknown"))


def main_program_ok(name: Column) -> Column:
    """A usable program name: not empty, no slash, no control character, not a dot name."""
    return F.coalesce(name.rlike(r"^[^/\x00-\x1f]+$") & ~name.isin(".", ".."), F.lit(False))


def encodable(text: Column) -> Column:
    """Paths and targets with NUL or line feed are not recorded."""
    return ~F.coalesce(text.rlike(r"[\x00\n]"), F.lit(False))

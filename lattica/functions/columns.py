"""Column builders for dictionary and feature strings. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line: leading blanks skipped, quotes undone, a trailing empty field dropped."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',[ \t]*("(?:[^"]|"")*"[^,]*|[^,]*)'), 1)
    plain = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_extract(x, '^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when((F.size(plain) > 0) & (F.element_at(plain, -1) == ""), F.slice(plain, F.lit(1), F.size(plain) - 1)).otherwise(plain)


def csv_head(line: Column, n: int) -> tuple[list[Column], Column]:
    """The first n fields and the rest, verbatim."""
    field = r'[ \t]*(?:"(?:[^"]|"")*"[^,]*|[^,]*)'
    pattern = "^" + ",".join([f"({field})"] * n) + ",(.*)$"
    unquote = lambda c: F.when(F.ltrim(c).startswith('"'), F.replace(F.regexp_extract(c, '^[ \t]*"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))).otherwise(F.regexp_replace(c, "^[ \t]+", ""))
    return [unquote(F.regexp_extract(line, pattern, i + 1)) for i in range(n)], F.regexp_extract(line, pattern, n + 1)


def quote_field(value: Column) -> Column:
    """A field as CSV: quoted if it holds a comma or a quote."""
    return F.when(value.rlike('[,"]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def split_keep(value: Column, delimiters: str) -> Column:
    """Split at any of the delimiters; empty fields stay."""
    return F.split(value, "[" + delimiters.replace("\\", "\\\\").replace("]", "\\]") + "]", -1)


def split_runs(value: Column, delimiters: str) -> Column:
    """Split at runs of delimiters; empty fields go."""
    return F.filter(split_keep(value, delimiters), lambda x: x != "")


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, UPPER.lower())


def hex_number(value: Column) -> Column:
    """0x1F as a number."""
    return F.conv(F.substring(value, 3, 16), 16, 10).cast("int")


def number_prefix(value: Column) -> Column:
    """Leading integer of a string; null for an empty one, 0 where there is none."""
    digits = F.regexp_extract(value, r"^\s*([-+]?\d+)", 1)
    return F.when(value == "", F.lit(None)).when(digits == "", F.lit(0)).otherwise(digits.cast("int"))


def quantized_cost(value: Column, factor: int) -> Column:
    """Model weight to integer cost, clamped to 16 bits, toward zero."""
    return F.least(F.greatest(-value * factor, F.lit(-32767.0)), F.lit(32767.0)).cast("int")


def keyword_cost(surface: Column) -> Column:
    """Cost by length in bytes for dictionaries without a model."""
    return F.greatest(F.lit(-32767), F.greatest(F.lit(-36000.0), -400 * F.pow(F.octet_length(surface), F.lit(1.5))).cast("int"))


def log_cost(p: Column, factor: float = 200.0) -> Column:
    return (-F.log(p) * factor).cast("int")


def column_match(pattern: Column, feature: Column) -> Column:
    """Column-wise match with * wild over the shorter of both; a lone * matches everything."""
    p, f = csv_fields(pattern), csv_fields(feature)
    n = F.least(F.size(p), F.size(f))
    return (pattern == "*") | F.forall(F.zip_with(F.slice(p, F.lit(1), n), F.slice(f, F.lit(1), n), lambda a, b: (a == "*") | (a == b)), lambda x: x)


def dtoa(value: Column) -> Column:
    return F.format_string("%.6f", value)


def is_hangul(value: Column) -> Column:
    return value.rlike(r"^[\uAC00-\uD7A3]+$")


def final_consonant(value: Column) -> Column:
    """T or F for a word that ends in a Hangul syllable with or without a final consonant, else *."""
    last = F.ascii(F.right(value, F.lit(1)))
    return F.when(~last.between(0xAC00, 0xD7A3) | (value == ""), F.lit("*")).when((last - 0xAC00) % 28 > 0, F.lit("T")).otherwise(F.lit("F"))


def compound_parts(expression: Column) -> Column:
    """a/POS/CLASS+b/POS/CLASS as an array of (surface, pos, semantic_class)."""
    return F.transform(
        F.split(expression, r"\+"),
        lambda t: F.struct(F.get(F.split(t, "/"), F.lit(0)).alias("surface"), F.get(F.split(t, "/"), F.lit(1)).alias("pos"), F.get(F.split(t, "/"), F.lit(2)).alias("semantic_class")),
    )


def prefix_compounds(morphemes: Column) -> Column:
    """Concatenations of the first 1, 2, ... morphemes."""
    return F.transform(F.sequence(F.lit(1), F.size(morphemes)), lambda i: F.array_join(F.slice(morphemes, F.lit(1), i), ""))


def valid_expression(expression: Column, classes: list[str]) -> Column:
    """Five /-parts per index token: surface, pos, class, two positions that are integers; class known or *."""
    parts = F.transform(F.split(expression, r"\+"), lambda t: F.split(t, "/"))
    good = lambda p: (F.size(p) == 5) & F.get(p, F.lit(2)).isin(*classes, "*") & F.get(p, F.lit(3)).try_cast("int").isNotNull() & F.get(p, F.lit(4)).try_cast("int").isNotNull()
    return F.forall(parts, good)


def plain_dash(value: Column) -> Column:
    return F.translate(value, "\u2014", "\u2015")


"""Feature rewriting, part-of-speech ids, feature templates: rules compiled once into column expressions or plain functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.columns import csv_fields, quote_field
from lattica.plans.model import csv_quote, csv_split

Rule = tuple[str, str]


def cell_matches(pattern: str, value: str) -> bool:
    """A cell that begins with *, (A|B|C) or the value itself."""
    if pattern.startswith("*"):
        return True
    if pattern.startswith("(") and pattern.endswith(")"):
        return value in pattern[1:-1].split("|")
    return pattern == value


def _cell(pattern: str, value: Column) -> Column | None:
    if pattern.startswith("*"):
        return None
    if pattern.startswith("(") and pattern.endswith(")"):
        return value.isin(*pattern[1:-1].split("|"))
    return value == pattern


def rule_condition(pattern: str, fields: Column) -> Column:
    cells = csv_split(pattern)
    out = F.size(fields) >= len(cells)
    for i, cell in enumerate(cells):
        test = _cell(cell, F.get(fields, F.lit(i)))
        if test is not None:
            out = out & test
    return out


def _target(target: str, fields: Column) -> Column:
    out = []
    for cell in csv_split(target):
        parts = [F.lit(x) if k % 2 == 0 else F.coalesce(F.get(fields, F.lit(int(x) - 1)), F.lit("")) for k, x in enumerate(re.split(r"\$(\d+)", cell)) if k % 2 or x]
        out.append(quote_field(F.concat(*parts) if parts else F.lit("")))
    return F.concat_ws(",", *out)


def rewrite(rules: Sequence[Rule], feature: Column) -> Column:
    """The first rule whose pattern matches gives the target; null where none does."""
    fields, out = csv_fields(feature), None
    for pattern, target in rules:
        condition, value = rule_condition(pattern, fields), _target(target, fields)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(None).cast("string") if out is None else out


def rewrite_one(rules: Sequence[Rule], feature: str) -> str | None:
    """The same for a single string."""
    fields = csv_split(feature)
    for pattern, target in rules:
        cells = csv_split(pattern)
        if len(cells) <= len(fields) and all(cell_matches(p, v) for p, v in zip(cells, fields, strict=False)):
            fill = lambda m: fields[int(m[1]) - 1] if int(m[1]) <= len(fields) else ""
            return ",".join(csv_quote(re.sub(r"\$(\d+)", fill, cell)) for cell in csv_split(target))
    return None


def rewrite_features(features: DataFrame, rules: dict[str, Sequence[Rule]], column: str = "feature") -> DataFrame:
    """ufeature, lfeature, rfeature of each distinct feature, joined back."""
    distinct = features.select(column).distinct()
    three = distinct.select(column, *[rewrite(rules.get(s, ()), F.col(column)).alias(n) for s, n in (("unigram", "ufeature"), ("left", "lfeature"), ("right", "rfeature"))])
    return features.join(three, column)


def pos_id(rules: Sequence[tuple[str, int]], feature: Column) -> Column:
    """Part-of-speech id of the first matching pattern; 65535 where none matches, 1 without rules."""
    if not rules:
        return F.lit(1)
    fields, out = csv_fields(feature), None
    for pattern, value in rules:
        condition = rule_condition(pattern, fields)
        out = F.when(condition, F.lit(int(value))) if out is None else out.when(condition, F.lit(int(value)))
    return out.otherwise(65535)


def pos_of(rules: Sequence[tuple[str, int]]) -> Callable[[str], int]:
    def one(feature: str) -> int:
        fields = csv_split(feature)
        for pattern, value in rules:
            cells = csv_split(pattern)
            if len(cells) <= len(fields) and all(cell_matches(p, v) for p, v in zip(cells, fields, strict=False)):
                return int(value)
        return 65535 if rules else 1

    return one


_MACRO = re.compile(r"%(?:([FLR])(\?)?\[(\d+)\]|([tulrw])|(.))")


def template_text(template: str, cells: dict[str, list[str]], whole: dict[str, str]) -> str | None:
    """A template filled in; None where an asked-for cell is missing, or is * behind a question mark."""
    out, at = [], 0
    for m in _MACRO.finditer(template):
        out.append(template[at : m.start()])
        at = m.end()
        if m[5]:
            raise ValueError(f"unknown macro %{m[5]}")
        if m[4]:
            out.append(whole.get(m[4], ""))
            continue
        values, n = cells.get(m[1], []), int(m[3])
        if n >= len(values) or (m[2] and values[n] in ("*", "")):
            return None
        out.append(values[n])
    return "".join([*out, template[at:]])


def unigram_features(templates: Sequence[str], ufeature: str, char_type: int, word: str = "") -> list[str]:
    cells = {"F": csv_split(ufeature)}
    found = (template_text(t, cells, {"t": str(char_type), "u": ufeature, "w": word}) for t in templates)
    return [x for x in found if x is not None]


def bigram_features(templates: Sequence[str], left_r: str, right_l: str) -> list[str]:
    """left_r: right-rewritten feature of the left token (%L); right_l: left-rewritten feature of the right one (%R)."""
    cells = {"L": csv_split(left_r), "R": csv_split(right_l)}
    found = (template_text(t, cells, {"l": right_l, "r": left_r}) for t in templates)
    return [x for x in found if x is not None]


def template_column(template: str, cells: dict[str, Column], whole: dict[str, Column]) -> Column:
    """template_text as a column; cells are arrays; null where the text is None."""
    parts, conditions, at = [], [], 0
    for m in _MACRO.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[5]:
            raise ValueError(f"unknown macro %{m[5]}")
        if m[4]:
            parts.append(whole[m[4]].cast("string"))
            continue
        value = F.get(cells[m[1]], F.lit(int(m[3])))
        conditions.append(value.isNotNull() & ~value.isin("*", "") if m[2] else value.isNotNull())
        parts.append(value)
    if at < len(template):
        parts.append(F.lit(template[at:]))
    text = F.concat(*parts) if parts else F.lit("")
    for c in conditions:
        text = F.when(c, text)
    return text


def expand_templates(tokens: DataFrame, templates: Sequence[str], ufeature: str = "ufeature", char_type: str = "char_type", surface: str = "surface") -> DataFrame:
    """tokens with one row per unigram feature (column ``crf_feature``)."""
    cells = {"F": csv_fields(F.col(ufeature))}
    whole = {"t": F.col(char_type), "u": F.col(ufeature), "w": F.col(surface)}
    every = F.array(*[template_column(t, cells, whole) for t in templates])
    return tokens.withColumn("crf_feature", F.explode(F.filter(every, lambda x: x.isNotNull())))


def frequent(tokens: DataFrame, freq: int, column: str = "crf_feature") -> DataFrame:
    """column, n of the features that occur at least freq times."""
    return tokens.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= freq)

"""Output formats: templates compiled once to column expressions over token arrays; no exchange, no Python per row.

Template macros (fixed values): %S sentence, %L its bytes, %m surface, %M surface with blanks, %h part of speech id, %% percent, %c word cost,
%H features, %t class, %s status, %P and %pP probability, %pi id, %pS blanks, %ps and %pe byte offsets, %pC connection cost, %pw word
cost, %pc path cost, %pn cost of the step, %pb * on the best path, %pA and %pB log sums, %pl and %pL lengths, %phl and %phr context ids,
%f[n,...] and %FS[n,...] feature cells that don't begin with *, parted by tab or S. Unknown macros raise at compile time; a cell beyond the
features raises when it is met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.columns import csv_fields
from lattica.plans.model import EngineConf

#: Escapes; anything else after a backslash is NUL.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "s": " ", "\\": "\\"}
SIMPLE = {"h": "pos_id", "c": "wcost", "H": "feature", "t": "char_type", "s": "stat", "P": "prob", "m": "surface"}
AFTER_P = {"i": "node_id", "s": "start", "e": "end", "w": "wcost", "c": "cost", "P": "prob", "A": "alpha", "B": "beta", "l": "length", "L": "rlength"}

Part = str | tuple


def unescape(ch: str) -> str:
    return ESCAPES.get(ch, "\0")


def compile_template(template: str) -> list[Part]:
    """Literal strings and (macro, argument) pairs."""
    out: list[Part] = []
    it = iter(range(len(template)))
    for i in it:
        ch = template[i]
        if ch == "\\":
            out.append(unescape(template[i + 1 : i + 2]))
            next(it, None)
            continue
        if ch != "%":
            out.append(ch)
            continue
        macro = template[i + 1 : i + 2]
        next(it, None)
        at = i + 2
        if macro == "%":
            out.append("%")
        elif macro in "SLM" or macro in SIMPLE and macro:
            out.append((macro, None))
        elif macro == "p":
            kind = template[at : at + 1]
            next(it, None)
            if kind == "h":
                side = template[at + 1 : at + 2]
                next(it, None)
                if side not in ("l", "r"):
                    raise ValueError("l or r is needed after %ph")
                out.append(("p" + kind, side))
            elif kind == "p":
                mode, sep = template[at + 1 : at + 2], template[at + 2 : at + 3]
                next(it, None)
                next(it, None)
                if sep == "\\":
                    sep = unescape(template[at + 3 : at + 4])
                    next(it, None)
                if mode not in ("i", "c", "P") or not sep:
                    raise ValueError("i, c or P is needed after %pp")
                out.append(("pp", (mode, sep)))
            elif kind and (kind in AFTER_P or kind in "SCnb"):
                out.append(("p" + kind, None))
            else:
                raise ValueError(f"unknown macro %p{kind}")
        elif macro in ("f", "F") and macro:
            sep = "\t"
            if macro == "F":
                sep = template[at : at + 1]
                next(it, None)
                at += 1
                if sep == "\\":
                    sep = unescape(template[at : at + 1])
                    next(it, None)
                    at += 1
            stop = template.find("]", at)
            cells = template[at + 1 : stop].split(",") if template[at : at + 1] == "[" and stop > 0 else ["?"]
            if not all(c.isdigit() for c in cells):
                raise ValueError("cells must be given as [n,...]")
            for _ in range(stop + 1 - at):
                next(it, None)
            out.append(("f", (sep, tuple(map(int, cells)))))
        else:
            raise ValueError(f"unknown macro %{macro}")
    merged: list[Part] = []
    for part in out:
        if isinstance(part, str) and merged and isinstance(merged[-1], str):
            merged[-1] += part
        else:
            merged.append(part)
    return merged


def _cells(feature: Column, sep: str, cells: tuple[int, ...]) -> Column:
    """Chosen cells; starred ones vanish, and a separator stands only before a cell whose predecessor in the list was printed."""
    fields = csv_fields(feature)
    get = lambda n: F.when(F.size(fields) > n, F.get(fields, F.lit(n))).otherwise(F.raise_error(F.lit("given index is out of range")).cast("string"))
    out, before = [], None
    for n in cells:
        shown = ~get(n).startswith("*")
        text = F.when(shown, get(n)).otherwise("")
        out.append(text if before is None else F.concat(F.when(shown & before, F.lit(sep)).otherwise(""), text))
        before = shown
    return F.concat(*out)


def node_text(parts: list[Part], token: Column, sentence: Column, previous: Column | None = None) -> Column:
    """One token as text; previous is the token before it on the path (null for the first)."""
    raw = F.coalesce(sentence, F.lit("")).cast("binary")
    out = []
    before_cost = F.coalesce(previous["cost"], F.lit(0)) if previous is not None else F.lit(0)
    for part in parts:
        if isinstance(part, str):
            out.append(F.lit(part))
            continue
        macro, arg = part
        if macro == "S":
            out.append(F.coalesce(sentence, F.lit("")))
        elif macro == "L":
            out.append(F.octet_length(raw).cast("string"))
        elif macro == "M":
            out.append(F.decode(F.substr(raw, token["begin"] + 1, token["rlength"]), "UTF-8"))
        elif macro == "pS":
            out.append(F.decode(F.substr(raw, token["begin"] + 1, token["rlength"] - token["length"]), "UTF-8"))
        elif macro == "pC":
            out.append((token["cost"] - before_cost - token["wcost"]).cast("string"))
        elif macro == "pn":
            out.append((token["cost"] - before_cost).cast("string"))
        elif macro == "pb":
            out.append(F.when(token["isbest"], "*").otherwise(" ") if arg else F.lit("*"))
        elif macro == "ph":
            out.append(token["left_id" if arg == "l" else "right_id"].cast("string"))
        elif macro == "pp":
            mode, sep = arg
            field = {"i": "lnode_id", "c": "path_cost", "P": "path_prob"}[mode]
            out.append(F.array_join(F.transform(token["paths"], lambda p, field=field: p[field].cast("string")), sep))
        elif macro == "f":
            out.append(_cells(token["feature"], *arg))
        else:
            name = SIMPLE.get(macro) or AFTER_P[macro[1]]
            value = token[name]
            out.append(F.format_string("%.6f", value.cast("double")) if name in ("prob", "alpha", "beta") else value.cast("string"))
    return F.concat(*out) if out else F.lit("")


def user_format(conf: EngineConf, key: str | None = None) -> Callable[[Column, Column], Column]:
    """(tokens, sentence) -> text by the node, unknown, begin and end templates of the settings or of a named set."""
    named = conf.formats(key)
    node, unk = compile_template(named.node_format), compile_template(named.unk_format if key or named.unk_format != EngineConf().unk_format else named.node_format)
    bos, eos = compile_template(named.bos_format), compile_template(named.eos_format)
    end = F.struct(*[F.lit(0).alias(x) for x in ("begin", "start", "end", "length", "rlength", "left_id", "right_id", "pos_id", "char_type", "wcost", "cost", "node_id")], F.lit("").alias("surface"), F.lit(conf.bos_feature).alias("feature"))

    def write(tokens: Column, sentence: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            return F.when(t["stat"] == 1, node_text(unk, t, sentence, before)).otherwise(node_text(node, t, sentence, before))

        return F.concat(node_text(bos, end, sentence), F.array_join(F.transform(tokens, one), ""), node_text(eos, end, sentence))

    return write


def default_format(tokens: Column) -> Column:
    """surface TAB features on a line each, then EOS."""
    return F.concat(F.array_join(F.transform(tokens, lambda t: F.concat(t["surface"], F.lit("\t"), t["feature"], F.lit("\n"))), ""), F.lit("EOS\n"))


def wakati(tokens: Column) -> Column:
    """Surfaces, each followed by a blank."""
    return F.concat(F.array_join(F.transform(tokens, lambda t: F.concat(t["surface"], F.lit(" "))), ""), F.lit("\n"))


def nothing(tokens: Column) -> Column:
    return F.lit("")


def dump(nodes: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a line of 14 fields and the incoming paths of every node, in printing order."""
    into = paths.groupBy(*keys, F.col("rnode_id").alias("node_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lnode_id", "path_cost", "path_prob"))), lambda p: F.concat_ws(":", p["lnode_id"], p["path_cost"], F.format_string("%.6f", p["path_prob"].cast("double")))), " ").alias("paths")
    )
    name = F.when(F.col("stat") == 2, "BOS").when(F.col("stat") == 3, "EOS").otherwise(F.col("surface"))
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    fields = ["node_id", name, "feature", "start", "end", "right_id", "left_id", "pos_id", "char_type", "stat", F.col("isbest").cast("int"), number("alpha"), number("beta"), number("prob"), "cost"]
    rows = nodes.join(into, [*keys, "node_id"], "left")
    line = F.concat_ws(" ", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in fields], "paths")
    place = F.when(F.col("stat") == 2, -1).when(F.col("stat") == 3, 1 << 40).otherwise(F.col("begin"))
    lines = F.sort_array(F.collect_list(F.struct(place.alias("p"), (-F.col("node_id")).alias("i"), line.alias("line"))))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def expectation_lines(nodes: DataFrame, paths: DataFrame, keys: list[str], floor: float = 1e-4) -> DataFrame:
    """keys, line: U and B lines of probabilities of floor and more."""
    name = F.when(F.col("stat") == 2, "BOS").when(F.col("stat") == 3, "EOS").otherwise(F.col("surface"))
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    u = nodes.filter(F.col("prob") >= floor).select(*keys, F.concat_ws("\t", F.lit("U"), name, "feature", number("prob")).alias("line"))
    b = paths.filter(F.col("path_prob") >= floor).select(*keys, F.concat_ws("\t", F.lit("B"), "lfeature", "rfeature", number("path_prob")).alias("line"))
    return u.unionByName(b)


def nbest_text(nbest: DataFrame, keys: list[str], eon: str = "") -> DataFrame:
    """keys, text: the ranked results one after another in the default format, then the end-of-n-best text."""
    token = F.when(F.col("stat") < 2, F.concat("surface", F.lit("\t"), "feature", F.lit("\n"))).otherwise("")
    each = nbest.groupBy(*keys, "rank").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", token.alias("t")))), lambda x: x["t"]), ""), F.lit("EOS\n")).alias("one"))
    return each.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "one"))), lambda x: x["one"]), ""), F.lit(eon)).alias("text"))

"""Column functions over names, paths, ranges and prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

# One segment of a dotted name, quoted or plain, and what splits lines.
SEGMENT = r"(?:«[^»\n]+»|[\p{L}_][\p{L}\p{N}_'₀-₉]*)"
NAME = rf"{SEGMENT}(?:\.{SEGMENT})*"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
# The shard hash (FNV-1a, 32 bit).
FNV_START, FNV_PRIME, SHARDS = 2166136261, 16777619, 256


def qualified_id(repo: Column, local: Column) -> Column:
    """Composite id that cannot collide, whatever the parts contain."""
    return F.to_json(F.array(repo, local))


def digest(*cols: Column | str) -> Column:
    """Stable row digest: the columns, in the given order, as JSON."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def stable_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(value, 256), 1, 24))


def slice_lines(text: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Text of a 1-based range with exclusive end column; missing columns mean whole lines."""
    lines = F.split(text, "\n")
    picked = F.slice(lines, start_line, end_line - start_line + 1)
    body = F.array_join(picked, "\n")
    cut = F.when(end_col.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.length(F.element_at(picked, -1)) - (end_col - 1)))
    skip = F.coalesce(start_col - 1, F.lit(0))
    return F.substr(body, skip + 1, F.greatest(F.lit(0), F.length(body) - skip - cut))


def tokens_with_columns(lines: DataFrame, keys: list[str], line: str = "line", pattern: str = NAME) -> DataFrame:
    """(keys, token, col): every match of every line with its 1-based column.

    Matches and the gaps before them are laid side by side; their running length is
    the column.  One line bounds the window.
    """
    found, gaps = F.regexp_extract_all(line, F.lit(f"({pattern})"), 1), F.split(line, pattern)
    pairs = lines.select(*keys, F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("token"))).alias("i", "p")).select(
        *keys, "i", "p.gap", "p.token")
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.select(*keys, "token", (F.sum(F.length("gap") + F.length("token")).over(upto) - F.length("token") + 1).alias("col"))


def name_parts(name: Column) -> Column:
    """Components of a dotted name; dots inside a quoted segment do not separate."""
    return F.regexp_extract_all(name, F.lit(f"({SEGMENT})"), 1)


def html_text(html: Column) -> Column:
    """Text between tags, with the common entities decoded and white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def shorten(text: Column, limit: int = 360) -> Column:
    """White space collapsed and cut to ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def unwrap(text: Column, begin: str, note: str) -> Column:
    """Body after a generated ``begin`` marker, without the generated block comment that starts with ``note``."""
    body = F.ltrim(F.substr(text, F.instr(text, begin) + len(begin)))
    bare = F.regexp_replace(body, rf"(?s)/--\n{re.escape(note)}.*?-/", "")
    return F.when(text.contains(begin), F.trim(bare)).otherwise(text)


def normal_path(path: Column) -> Column:
    """Path without ``.``, ``..`` and empty parts; null when it is absolute or climbs out."""
    start = F.array().cast("array<string>")

    def step(acc, part):
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != "..")
        return F.when(part.isin("", "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))

    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.aggregate(F.split(clean, "/"), start, step)
    return F.when(~clean.startswith("/") & (F.coalesce(F.get(parts, F.lit(0)), F.lit("")) != ".."),
                  F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit(".")))


def fnv_shard(name: Column) -> Column:
    """Shard of a name: FNV-1a over its UTF-8 bytes, modulo 256, folded in JVM expressions."""
    hexed = F.hex(F.encode(name, "UTF-8"))
    at = F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int"))
    byte = lambda i: F.conv(F.substr(hexed, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    mask = F.lit(0xFFFFFFFF)
    full = F.aggregate(F.transform(at, byte), F.lit(FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(mask))
    return F.when(F.length(hexed) == 0, F.lit(FNV_START % SHARDS)).otherwise(full % SHARDS).cast("int")


def span_or_null(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Zero-based columns to one-based; an empty or backward span is null."""
    forward = (start_line < end_line) | ((start_line == end_line) & (start_col < end_col))
    return F.when(forward, F.struct(start_line.alias("start_line"), (start_col + 1).alias("start_column"),
                                    end_line.alias("end_line"), (end_col + 1).alias("end_column")))


# A backslash escapes inside strings only.
_CODE = re.compile(r'/-|-/|--|"|\n|[^/\-"\n]+|.', re.S)
_QUOTED = re.compile(r'\\.|"|[^\\"]+|\\', re.S)


def _without_comments(text: str) -> str:
    depth, quoted, line_comment, at, out = 0, False, False, 0, []
    while at < len(text):
        piece = (_QUOTED if quoted else _CODE).match(text, at).group()
        at += len(piece)
        if line_comment:
            line_comment = piece != "\n"
            if not line_comment:
                out.append(piece)
        elif depth:
            depth += {"/-": 1, "-/": -1}.get(piece, 0)
            if piece == "\n":
                out.append(piece)
        elif quoted:
            out.append(piece)
            quoted = piece != '"'
        elif piece == "/-":
            depth = 1
            out.append(" ")
        elif piece == "--":
            line_comment = True
        else:
            out.append(piece)
            quoted = piece == '"'
    return "\n".join(x for x in "".join(out).splitlines() if x.strip())


@F.pandas_udf(StringType())
def strip_comments(texts: pd.Series) -> pd.Series:
    """Source without line comments, nested block comments and blank lines; nesting needs a counter, hence Python."""
    return texts.map(_without_comments, na_action="ignore")

"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick automaton holds every case variant of the assignment keywords, the
key prefixes, and all runs of ``HEX_GRAM`` hexadecimal digits; a text is read once and
expressions are tried only where the automaton hit.  Every match begins with a
keyword, so taking the hits in order and skipping those inside the last match of the
same kind gives the leftmost non-overlapping matches.

Base kinds: ``assign``, ``access``, ``hex``.  Added kinds hold a checksum and count only
if it is right: ``checked`` are tokens whose last six characters are the CRC-32 of
what stands before, in base 62.

Cases: null and empty texts have no spans; a text of any length is read whole; spans
are in code points, end exclusive, ordered by start and then by kind as listed.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwork.llm.texts import pieces

# The patterns of the base kinds, and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Tokens with an embedded checksum are such a prefix, 30 characters and six of checksum.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "checked")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_GRAM = 4


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n or len(out) < width:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in KEYWORDS:
        for variant in itertools.product(*({c, c.upper()} for c in word)):
            a.add_word("".join(variant), (0, len(word)))
    a.add_word("AKIA", (1, 4))
    for gram in itertools.product("0123456789abcdef", repeat=HEX_GRAM):
        a.add_word("".join(gram), (2, HEX_GRAM))
    for prefix in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        a.add_word(prefix, (3, len(prefix)))
    a.make_automaton()
    return a


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets, in order."""
    found, done = [], [0, 0, 0, 0]
    for last, (kind, n) in automaton().iter(text):
        at = last + 1 - n
        if at < done[kind]:
            continue
        if kind == 0:
            # An assignment keyword may end inside a longer one's hit; each is tried where it begins.
            if m := ASSIGN.match(text, at):
                done[0] = m.end()
                if m.end(2) - m.start(2) >= LEAST["assign"]:
                    found.append((at, 0, m.end()))
        elif kind == 1:
            if m := ACCESS.match(text, at):
                done[1] = m.end()
                if m.end() - at >= LEAST["access"]:
                    found.append((at, 1, m.end()))
        elif kind == 2:
            end = HEX.match(text, at).end()
            done[2] = end
            if end - at >= LEAST["hex"]:
                found.append((at, 2, end))
        elif (m := CHECKED.match(text, at)) and base62(zlib.crc32(m[1].encode())) == m[2]:
            done[3] = m.end()
            found.append((at, 3, m.end()))
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by the kind of its first span."""
    out, at = [], 0
    for a, k, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_checked, base_sha256, spans) of every row."""

    def run(batches):
        for part, texts in pieces(batches):
            found = [spans(t) for t in texts]
            count = lambda k: pa.array([sum(s[1] == k for s in f) for f in found], pa.int64())
            base = [hashlib.sha256(listed([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(count, range(4)), pa.array(base), pa.array([listed(f) for f in found])],
                                             ["key", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(
        run, f"key {kind}, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")
    return out.withColumnRenamed("key", key)


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in ``text``, and their length in ``length`` where that column is."""

    def run(batches):
        for part, texts in pieces(batches, text):
            found = [spans(t) for t in texts]
            if any(found):
                clean = [redact(t, f) if f else t for t, f in zip(texts, found)]
                nulls = part.column(text).is_null().to_pylist()
                columns = {name: part.column(name) for name in part.schema.names}
                columns[text] = pa.array([None if n else c for n, c in zip(nulls, clean)], pa.string())
                if length in columns:
                    sizes = [len(c) if f else old for c, f, old in zip(clean, found, columns[length].to_pylist())]
                    columns[length] = pa.array(sizes, columns[length].type)
                part = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield part

    return docs.mapInArrow(run, docs.schema)

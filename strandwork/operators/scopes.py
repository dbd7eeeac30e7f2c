"""Scopes of source lines: namespace, opened namespaces, aliases and visibility, for files of any length.

The commands of a stretch of lines act on the stack of scopes as one list of steps, from which
everything that opens and closes inside the stretch has dropped out.  Such lists compose: a file
is cut into blocks of lines, the blocks are reduced in parallel, their lists are run one
after the other (a few steps a block), and each block is then read again from the stack that it
begins with.  Lines are expected without comments and strings.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.session import dealt

#: Lines of a block.
BLOCK = 4096
# The commands that change scopes.
SCOPE = re.compile(r"(?:(public|private)\s+)?(namespace|section)\b\s*(.*)")
ATTRIBUTES = re.compile(r"^(?:@\[[^\[\]]*\]\s*)+")
NAME = r"[^\W\d][\w.!?']*"
ALIAS = re.compile(rf"alias\s+({NAME})\s*:=\s*({NAME})")
IMPORT = r"^\s*(?:(?:public|private)\s+)?import\s+(.+)"


def steps(line: str) -> list[list]:
    """What one line does to the scopes, as lists that JSON can hold."""
    line, out = line.strip(), []
    if line == "module":
        out.append(["module"])
    if m := SCOPE.match(ATTRIBUTES.sub("", line)):
        out.append(["push", m[2], m[3].strip(), m[1]])
    elif m := re.match(r"end\b(.*)", line):
        out.append(["end", m[1].strip()])
    elif re.match(r"open\s+", line) and not re.search(r"\bin\s*$", line):
        names = re.findall(NAME, line)[1:]
        if names and names[0] != "scoped":
            out.append(["open", names])
    if m := ALIAS.match(line):
        out.append(["alias", m[1], m[2]])
    return out


def reduced(every: list[list]) -> list[list]:
    """The same effect on any stack, without scopes that both open and close inside."""
    out: list[list] = []
    # Scopes of this stretch that are certainly open: where they were pushed, and their names.
    own: list[tuple[int, str]] = []

    def close(k: int) -> None:
        del out[own[k][0] :]
        del own[k:]

    for step in every:
        if step[0] == "push":
            own.append((len(out), step[2]))
            out.append(step)
        elif step[0] != "end":
            out.append(step)
        elif not step[1]:
            if own:
                close(len(own) - 1)
            else:
                out.append(step)
        else:
            names = [n for _, n in own]
            at = next((k for k in range(len(own) - 1, -1, -1) if ".".join(names[k:]) == step[1]), None)
            if at is not None:
                close(at)
            elif not names or step[1].endswith("." + ".".join(names)):
                # It may reach scopes from before this stretch; what is open here is then no longer certain.
                out.append(step)
                own.clear()
    return out


def run(stack: list[dict], step: list) -> None:
    """One step on a stack of scopes, the outermost first; scopes are never changed in place."""
    top = stack[-1]
    if step[0] == "module":
        stack[-1] = {**top, "public": False}
    elif step[0] == "push":
        _, kind, name, said = step
        inner = ".".join(filter(None, (top["namespace"], name))) if kind == "namespace" else top["namespace"]
        stack.append({**top, "name": name, "namespace": inner, "public": said == "public" if said else top["public"]})
    elif step[0] == "open":
        stack[-1] = {**top, "opens": top["opens"] + [{"at": top["namespace"], "name": n} for n in step[1]]}
    elif step[0] == "alias":
        full = ".".join(filter(None, (top["namespace"], step[1])))
        stack[-1] = {**top, "aliases": top["aliases"] + [{"alias": full, "target": step[2]}]}
    elif not step[1]:
        if len(stack) > 1:
            stack.pop()
    else:
        names = [s["name"] for s in stack[1:]]
        for k in range(len(names) - 1, -1, -1):
            if ".".join(names[k:]) == step[1]:
                del stack[k + 1 :]
                break


def outermost() -> list[dict]:
    return [{"name": "", "namespace": "", "opens": [], "aliases": [], "public": True}]


def contexts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, namespace, opens, aliases, public) in force after each of ``lines(key, line_no, line)``.

    Null lines are empty; line numbers give the order, and equal numbers of one file stand in any order.
    """
    rows = lines.select(F.col(key).alias("key"), F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"),
                        F.floor(F.col("line_no") / BLOCK).cast("long").alias("block"))

    file = F.struct("key").alias("file")
    rows = rows.select(file, "block", "line_no", "line").repartition("file", "block")

    def told(kinds: pa.Schema, found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), kinds)], schema=kinds)

    def shorten(batches):
        kinds, last, own = None, None, []
        for batch in batches:
            kinds = pa.schema([batch.schema.field("file"), ("block", pa.int64()), ("steps", pa.string())])
            found = []
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line"))):
                if last != (file, block):
                    if last is not None:
                        found.append((*last, json.dumps(reduced(own))))
                    last, own = (file, block), []
                own += steps(line)
            if found:
                yield told(kinds, found)
        if last is not None:
            yield told(kinds, [(*last, json.dumps(reduced(own)))])

    def enter(batches):
        last, stack = None, []
        for batch in batches:
            kinds = pa.schema([batch.schema.field("file"), ("block", pa.int64()), ("stack", pa.string())])
            found = []
            for file, block, own in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "steps"))):
                if last is None or last != file:
                    last, stack = file, outermost()
                found.append((file, block, json.dumps(stack)))
                for step in json.loads(own):
                    run(stack, step)
            if found:
                yield told(kinds, found)

    def read(batches):
        name = pa.struct([("at", pa.string()), ("name", pa.string())])
        alias = pa.struct([("alias", pa.string()), ("target", pa.string())])
        last, stack = None, []
        for batch in batches:
            kinds = pa.schema([("file", batch.schema.field("file").type), ("line_no", pa.int64()), ("namespace", pa.string()), ("opens", pa.list_(name)),
                               ("aliases", pa.list_(alias)), ("public", pa.bool_())])
            found = []
            for file, block, line_no, line, entered in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line_no", "line", "stack"))):
                if last != (file, block):
                    last, stack = (file, block), outermost() if entered is None else json.loads(entered)
                for step in steps(line):
                    run(stack, step)
                top = stack[-1]
                found.append((file, line_no, *(top[c] for c in ("namespace", "opens", "aliases", "public"))))
            if found:
                yield told(kinds, found)

    # Lines are shuffled once, by block; a worker reads the blocks of its part one after the other, so
    # that many short files cost no call each.  A file's blocks meet with their few steps only.
    held = rows.schema["file"].dataType.simpleString()
    short = rows.sortWithinPartitions("file", "block", "line_no").mapInArrow(shorten, f"file {held}, block long, steps string")
    entering = short.repartition("file").sortWithinPartitions("file", "block").mapInArrow(enter, f"file {held}, block long, stack string")
    entering = entering.where(F.col("stack") != json.dumps(outermost()))
    out = rows.join(dealt(entering), ["file", "block"], "left")
    out = out.select("file", "block", "line_no", "line", "stack").sortWithinPartitions("file", "block", "line_no").mapInArrow(
        read, f"file {held}, line_no long, namespace string, opens array<struct<at: string, name: string>>, "
              "aliases array<struct<alias: string, target: string>>, public boolean")
    return out.select(F.col("file.key").alias(key), "line_no", "namespace", "opens", "aliases", "public")


def imports(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, module) that import commands name, each once."""
    named = F.regexp_extract_all(F.regexp_extract("line", IMPORT, 1), F.lit(r"([\p{L}_][\p{L}\p{N}_.!?']*)"), 1)
    return lines.where(F.col("line").rlike(IMPORT)).select(F.col(key), F.explode(named).alias("module")).distinct()

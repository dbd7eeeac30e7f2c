"""Fact packages, inventories, compiled packages and artifact tables on disk."""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from strandwork.functions import sha256
from strandwork.session import dealt, materialize, measured

# The strict shape of a package document; reading anything else fails.
TEXT = "struct<text:string,status:string,reason:string>"
DEP = "struct<provider:struct<repo_key:string,local_id:string>,evidence_kind:string,provider_module:string>"
PART = f"struct<nl:{TEXT},formal:{TEXT},deps:array<{DEP}>>"
REF = "struct<repo_key:string,local_id:string>"
PACKAGE = (
    "workspace_id string, "
    f"manifest struct<repositories:array<struct<repo_key:string,toolchain:string,root_scope:string,revision:string,input_digest:string,version_status:string,primary_outcomes:array<{REF}>>>,"
    "assets:array<struct<asset_id:string,repo_key:string,path:string,sha256:string>>,"
    "dependency_locks:array<struct<repo_key:string,dependency_repo_key:string>>>, "
    "scopes array<struct<scope_id:string,repo_key:string,kind:string,name:string,parent:string>>, "
    f"units array<struct<unit_id:string,representative:{REF},members:array<string>>>, "
    f"declarations array<struct<ref:{REF},lean_name:string,module:string,native_scope:string,kind:string,local_public:boolean,generated_from:{REF},statement:{PART},proof:{PART}>>")
NESTED = f"ref {REF}, lean_name string, module string, local_public boolean, statement {PART}"
DECLARATION = f"repo_key string, local_id string, name string, module string, kind string, local_public boolean, statement {TEXT}, proof {TEXT}"


def read_packages(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of whole-document packages; a document that does not fit the schema fails the read."""
    doc = spark.read.schema(PACKAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ws = F.col("workspace_id")
    rows = lambda c: doc.select(ws, F.explode(c).alias("r")).select("workspace_id", "r.*")
    decl = doc.select(ws, F.explode("declarations").alias("r"))
    deps = [decl.select("workspace_id", F.col("r.ref").alias("consumer"), F.lit(p).alias("part"), F.explode(f"r.{p}.deps").alias("x")).select(
        "workspace_id", "x.provider", "consumer", "part", "x.evidence_kind", "x.provider_module") for p in ("statement", "proof")]
    return {
        "repos": rows("manifest.repositories").drop("primary_outcomes"), "assets": rows("manifest.assets"), "locks": rows("manifest.dependency_locks"),
        "primary_outcomes": doc.select(ws, F.explode("manifest.repositories").alias("r")).select("workspace_id", F.explode("r.primary_outcomes").alias("x")).select("workspace_id", "x.*"),
        "scopes": rows("scopes"), "units": rows("units"),
        "decls": decl.select("workspace_id", "r.ref.*", "r.lean_name", "r.module", "r.native_scope", "r.kind", "r.local_public", "r.generated_from",
                             F.col("r.statement.formal").alias("statement"), F.col("r.proof.formal").alias("proof")),
        "dep_occurrences": deps[0].unionAll(deps[1])}


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """Declarations as JSON lines: splittable, so a package may be of any size."""
    return spark.read.schema(DECLARATION).option("mode", "FAILFAST").json(path)


def field_report(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """(field, n): unknown fields, and lines that are no JSON or repeat a key (as field null)."""
    lines = spark.read.text(path)
    keys = lines.select(F.try_parse_json("value").alias("v"), "value").select(
        F.when(F.col("v").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.json_object_keys("value")).alias("keys"))
    return keys.select(F.explode("keys").alias("field")).where(F.col("field").isNull() | ~F.col("field").isin(allowed)).groupBy("field").agg(F.count("*").alias("n"))


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """A bundle as one parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def table_digest(df: DataFrame) -> DataFrame:
    """One row: row count and an order-free digest (sums of two halves of every row hash)."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    return df.agg(F.count("*").alias("rows"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))


def save_artifact(df: DataFrame, path: str, kind: str, inputs: Mapping[str, str] | None = None) -> None:
    """An artifact table and its manifest row: kind, digest, and the digests of what it was made from."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    saved = df.sparkSession.read.parquet(f"{path}/data")
    made = F.lit(",".join(f"{k}={v}" for k, v in sorted((inputs or {}).items())))
    table_digest(saved).select(F.lit(kind).alias("kind"), "rows", "high", "low", made.alias("inputs")).write.mode("overwrite").parquet(f"{path}/manifest")


def load_artifact(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The artifact, refused when its kind or digest is not the recorded one."""
    data = spark.read.parquet(f"{path}/data")
    note, now = spark.read.parquet(f"{path}/manifest").first(), table_digest(data).first()
    if note["kind"] != kind or (note["rows"], note["high"], note["low"]) != (now["rows"], now["high"], now["low"]):
        raise ValueError(f"artifact does not match its manifest: {path}")
    return data


# Declarations of a chunk and lines of a shard, at most.
PER_CHUNK, PER_SHARD = 1000, 5000


def write_inventory(rows: DataFrame, path: str, per_chunk: int = PER_CHUNK, per_shard: int = PER_SHARD) -> None:
    """Inventory lines in chunks of at most ``per_chunk`` per file and shards of at most ``per_shard`` lines.

    ``rows(file, ordinal, ...)`` with ordinals from 0 inside each file.
    """
    count = rows.groupBy("file").agg(F.ceil(F.count("*") / F.lit(per_chunk)).alias("chunk_count"))
    chunked = rows.join(count, "file").withColumn("chunk_index", F.floor(F.col("ordinal") / per_chunk))
    chunked.write.mode("overwrite").option("maxRecordsPerFile", per_shard).json(path)


#: Bytes up to which a file is read whole by one task; a larger one is read by splits.
WHOLE = 64 << 20
#: Bytes of a split that are handed on as one row.
PIECE = 1 << 20
#: Files that Hadoop would unpack when read as text; they are read whole.
PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|passthrough)$"


def shard_digests(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, sha256, bytes) of every file, to be checked against a manifest.

    A file above ``WHOLE`` bytes is read by as many tasks as it has splits, and its digest goes from split to split.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    whole = lambda df: df.select(name, F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))
    # By its length alone Spark knows which content not to read.
    told, long = whole(files.where(F.col("length") <= WHOLE)), files.where(F.col("length") > WHOLE)
    packed = [x["path"] for x in long.where(name.rlike(PACKED)).select("path").collect()]
    if packed:
        told = told.unionAll(whole(spark.read.format("binaryFile").load(packed)))
    long = long.where(~name.rlike(PACKED)).select(F.col("_metadata.file_path").alias("key"), name, "length")
    return told.unionAll(_long_digests(spark, path, glob, long)) if long.take(1) else told


def _long_digests(spark: SparkSession, path: str, glob: str, long: DataFrame) -> DataFrame:
    """``shard_digests`` of the files named by ``long(key, file, length)``.

    Splits are read as text cut at line feeds, which gives the bytes back as they are but for two things that the length
    tells: a last line without line feed, and a byte order mark in front.  A round takes the splits that begin at one place.
    """
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = text.where((meta("file_size") > WHOLE) & ~meta("file_name").rlike(PACKED)).select(
        meta("file_path").alias("key"), meta("file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def pieces(batches):
        at, seq, held, size = None, 0, [], 0
        tell = lambda: pa.RecordBatch.from_pydict({"key": [at[0]], "start": [at[1]], "seq": [seq], "bytes": [b"".join(held)]}, own)
        own = pa.schema([("key", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            for key, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, start) != at or size >= PIECE:
                    if held:
                        yield tell()
                    at, seq, held, size = (key, start), seq + 1, [], 0
                held += [line, b"\n"]
                size += len(line) + 1
        if held:
            yield tell()

    cut = materialize(rows.mapInArrow(pieces, "key string, start long, seq long, bytes binary"))
    plan = cut.groupBy("key").agg(F.sum(F.length("bytes")).alias("total"), F.min("start").alias("first"), F.max("start").alias("last")).join(dealt(long), "key")
    plan, seen = measured(plan.select("key", "file", "length", "first", "last", (F.col("total") - F.col("length")).alias("surplus"), F.lit(None).cast("binary").alias("state")),
                          odd=F.count_if(~F.col("surplus").isin(0, 1, -3, -2)))
    if seen["odd"]:
        raise ValueError(f"files cannot be read by splits: {path}")

    def advance(key, table):
        table = table.sort_by("seq")
        start, begun, end, surplus, state = (table[c][0].as_py() for c in ("start", "first", "last", "surplus", "state"))
        hashed = sha256.resumed(state)
        if start == begun and surplus < 0:
            hashed.update(b"\xef\xbb\xbf")
        for i, piece in enumerate(table["bytes"], 1):
            data = piece.as_py()
            # Without a line feed at the end of the file there is one too many.
            hashed.update(data[:-1] if start == end and i == len(table) and surplus in (1, -2) else data)
        return pa.table({"key": [key[0].as_py()], "now": [hashed.state()], "sha256": pa.array([hashed.hexdigest() if start == end else None], pa.string())})

    done = []
    for start in sorted(x["start"] for x in cut.select("start").distinct().collect()):
        step = materialize(cut.where(F.col("start") == start).join(dealt(plan), "key").groupBy("key").applyInArrow(
            advance, "key string, now binary, sha256 string"))
        done.append(step.where("sha256 IS NOT NULL").select("key", "sha256"))
        plan = materialize(plan.join(dealt(step.select("key", "now")), "key", "left").withColumn("state", F.coalesce("now", "state")).drop("now"))
    return functools.reduce(DataFrame.unionAll, done).join(dealt(long), "key").select("file", "sha256", F.col("length").cast("int").alias("bytes"))


def compiled_dependencies(compiled: DataFrame) -> DataFrame:
    """(name, part, evidence_kind, provider): type and value dependencies of compiled rows.

    A theorem's value is its proof; what has no separate proof keeps its value in the
    statement.
    """
    theorem = F.col("kind").isin("theorem", "lemma")
    of_type = compiled.select("name", F.lit("statement").alias("part"), F.lit("lean_type").alias("evidence_kind"), F.explode("type_deps").alias("provider"))
    of_value = compiled.select("name", F.when(theorem, "proof").otherwise("statement"), F.lit("lean_value"), F.explode("value_deps"))
    return of_type.unionAll(of_value).distinct()


class _Pairs(list):
    """An object as the pairs that it was written with, repeated keys included."""


#: What values of the plain types look like in JSON.
_PLAIN = {"string": str, "boolean": bool, "bigint": int, "int": int, "double": (int, float)}


def faults(text: str | None, shape: DataType) -> list[tuple[str, str]]:
    """(path, reason) of everything in a JSON text that does not fit ``shape``, at any depth.

    Reasons are ``unknown`` and ``duplicate`` keys, ``type`` of a value, and ``not_json`` for a text that is none; an
    element of an array has ``[]`` in its path.  Null fits any type; absent keys are no fault.
    """
    try:
        value = json.loads(text or "", object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return [("", "not_json")]
    found, open_ = [], [("", value, shape)]
    while open_:
        path, value, own = open_.pop()
        if value is None:
            continue
        if isinstance(own, StructType):
            if not isinstance(value, _Pairs):
                found.append((path, "type"))
                continue
            fields, seen = {f.name: f.dataType for f in own.fields}, set()
            for key, inner in value:
                at = f"{path}.{key}" if path else key
                if key in seen:
                    found.append((at, "duplicate"))
                elif key not in fields:
                    found.append((at, "unknown"))
                seen.add(key)
                if key in fields:
                    open_.append((at, inner, fields[key]))
        elif isinstance(own, ArrayType):
            if isinstance(value, _Pairs) or not isinstance(value, list):
                found.append((path, "type"))
            else:
                open_ += [(f"{path}[]", inner, own.elementType) for inner in value]
        else:
            kind = _PLAIN[own.simpleString()]
            if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
                found.append((path, "type"))
    return sorted(found)


def fault_report(documents: DataFrame, shape: str, key: str = "key", text: str = "text") -> DataFrame:
    """(key, path, reason, n) of the faults of each JSON text; one text is in memory at a time."""
    parsed = StructType.fromDDL(shape)

    def run(batches):
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                own = Counter(faults(t.as_py(), parsed))
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(own), batch.schema.field(0).type), pa.array([p for p, _ in own]), pa.array([r for _, r in own]),
                         pa.array(list(own.values()), pa.int64())], ["key", "path", "reason", "n"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, path string, reason string, n long").withColumnRenamed("key", key)


def read_strict(documents: DataFrame, shape: str, key: str = "key", text: str = "text") -> DataFrame:
    """(key, value) of the documents without any fault, as ``shape``; the others are left to ``fault_report``."""
    parsed = StructType.fromDDL(shape)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not faults(t.as_py(), parsed) for t in batch.column(1)], pa.bool_()))

    own = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(run, own.schema).select(F.col("key").alias(key), F.from_json("text", parsed).alias("value"))

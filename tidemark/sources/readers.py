"""Readers and writers: event lines, source trees, settings, content-addressed artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import glob_pattern

#: Folders that a source tree scan leaves out, and the largest text that is read.
SKIPPED_FOLDERS = (".git", "node_modules", "target", "build", "dist", ".next", ".idea", ".gradle", ".mvn", "__pycache__", ".venv", "coverage")
MAX_TEXT_BYTES = 2 * 1024 * 1024

EVENT = T.StructType([
    T.StructField("runId", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("at", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("role", T.StringType()), T.StructField("taskId", T.StringType()),
])
ARTIFACT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("runId", T.StringType()), T.StructField("relativePath", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("createdAt", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
])


def read_events_strict(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """JSON lines; a line that does not parse ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_events_lenient(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """JSON lines with the text of lines that do not parse in ``_corrupt``; blank lines are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.select("e.*")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def line_count(text):
    """Lines of a text; a line end at its end begins no further line, an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - text.endswith("\n").cast("int"))


def scan_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, bytes, text, lines) of the files below a folder, without the skipped ones. Large or
    binary files keep a null text; ``glob`` is matched against the path below the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substr(full, F.lit(len(root.rstrip("/")) + 2)) if root.startswith("/") else full
    out = files.select(rel.alias("path"), F.col("length").alias("bytes"), "content")
    out = out.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED_FOLDERS)))
    if glob:
        out = out.where(F.col("path").rlike(glob_pattern(glob)))
    readable = (F.col("bytes") <= MAX_TEXT_BYTES) & ~F.contains(F.decode(F.substring("content", 1, 8000), "ISO-8859-1"), F.lit("\u0000"))
    text = F.when(readable, F.try_validate_utf8(F.col("content").cast("string")))
    return out.select("path", "bytes", text.alias("text")).withColumn("lines", F.when(F.col("text").isNotNull(), line_count(F.col("text"))))


def content_ids(df: DataFrame, content: str, name: str = "artifact_id") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit("art_"), F.sha2(F.col(content), 256)))


def new_artifacts(index: DataFrame, written: DataFrame) -> DataFrame:
    """Rows of (path, content) that are not in the index (path, artifact_id) yet; the same path
    with the same content is a repeat, with another content an error, as artifacts only grow."""
    rows = content_ids(written, "content")
    old = index.select("path", F.col("artifact_id").alias("_old"))
    joined = rows.join(old, "path", "left")
    conflict = F.raise_error(F.concat(F.lit("another content under "), F.col("path"))).cast("boolean")
    keep = F.when(F.col("_old").isNull(), True).when(F.col("_old") == F.col("artifact_id"), False).otherwise(conflict)
    return joined.where(keep).drop("_old")


def upsert(index: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The index with rows of the same keys replaced and the others added; null keys never match."""
    return index.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def verify_artifacts(index: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of each indexed artifact: missing, tampered, size-mismatch or ok, in this order.

    ``index`` has path, sha256, bytes; ``files`` has path and content (binary or text)."""
    f = files.select(F.col("path").alias("_p"), F.sha2(F.col("content"), 256).alias("_sha"), F.octet_length("content").alias("_n"))
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "tampered").when(F.col("_n") != F.col("bytes"), "size-mismatch").otherwise("ok")
    return index.join(f, F.col("path") == F.col("_p"), "left").select("path", state.alias("state"))


def write_envelopes(df: DataFrame, path: str, kind: str, run_id: str) -> None:
    """One canonical JSON document per row: keys in order, payload wrapped with its kind and run."""
    payload = F.struct(*(F.col(c) for c in sorted(df.columns)))
    envelope = F.struct(F.lit("1").alias("envelopeVersion"), F.lit(kind).alias("kind"), payload.alias("payload"), F.lit(run_id).alias("runId"))
    df.select(F.to_json(envelope).alias("value")).write.mode("errorifexists").text(path)


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Payloads of enveloped or bare JSON documents, one per line."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    inner = F.coalesce(F.get_json_object("value", "$.payload"), F.col("value"))
    return raw.select(F.from_json(inner, schema).alias("p")).select("p.*")


def versioned_files(paths: DataFrame) -> DataFrame:
    """(path, kind, iteration, task): parts of names such as kind-r2-attempt-task_x.json."""
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return paths.select("path", F.regexp_extract(name, r"^([a-z]+(?:-[a-z]+)*?)(?:-r\d+)?(?:-attempt-.*)?$", 1).alias("kind"), F.coalesce(F.nullif(F.regexp_extract(name, r"-r(\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("iteration"), F.nullif(F.regexp_extract(name, r"-attempt-(.+)$", 1), F.lit("")).alias("task"))


def migrations(paths: DataFrame) -> DataFrame:
    """(path, version, description, repeatable) of migration scripts by their names."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    hit = r"(?i)^(?:V(\d+(?:[._]\d+)*)|(R))__(.+)\.sql$"
    return paths.where(name.rlike(hit)).select("path", F.nullif(F.regexp_extract(name, hit, 1), F.lit("")).alias("version"), F.replace(F.regexp_extract(name, hit, 3), F.lit("_"), F.lit(" ")).alias("description"), (F.regexp_extract(name, hit, 2) != "").alias("repeatable"))


def markdown_report(df: DataFrame, title: str, order: str) -> DataFrame:
    """A table as lines of Markdown with their places (pos, line): title, head, rule, rows in order.

    ``df`` is a finished report, whose rows a reader is to see; it is one text in the end."""
    from pyspark.sql import Window as W

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    body = df.select((F.row_number().over(W.orderBy(order)) + 2).alias("pos"), cells.alias("line"))
    head = df.sparkSession.createDataFrame([(0, f"# {title}"), (1, "| " + " | ".join(df.columns) + " |"), (2, "|" + " --- |" * len(df.columns))], "pos int, line string")
    return head.unionByName(body)


def list_folder(spark: SparkSession, root: str, recursive: bool = False, limit: int = 500) -> tuple[DataFrame, bool]:
    """(path, bytes) of the entries of a folder, in order, at most ``limit``, and whether there are more."""
    tree = scan_tree(spark, root).select("path", "bytes")
    entries = tree if recursive else tree.where(~F.contains("path", F.lit("/")))
    first = entries.orderBy("path").limit(limit + 1)
    return first.limit(limit), first.count() > limit


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An artifact index kept as one JSON array; anything else ends the query."""
    return spark.read.schema(ARTIFACT).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as immutable Parquet folders; a snapshot is never written over."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_checked(df: DataFrame, path: str, facts: dict) -> None:
    """Write a report as JSON lines if every fact (an aggregate and its expected value) holds."""
    row = df.agg(*(expr.alias(n) for n, (expr, _) in facts.items())).first()
    wrong = [n for n, (_, want) in facts.items() if row[n] != want]
    if wrong:
        raise ValueError(f"facts that do not hold: {', '.join(wrong)}")
    df.write.mode("errorifexists").json(path)

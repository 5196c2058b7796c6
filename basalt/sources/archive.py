"""Export archives that are there as a whole or not at all, and edge tables that only a newer revision replaces.

An archive is a folder. Tasks write parts under a name of the export's own; the commit, on the driver, checks the parts' counts against the
budgets, writes a manifest of their digests, and last renames one small file, CURRENT, which is all that readers follow. Parts of tasks
that were killed, tried twice or aborted are in no manifest. Reading checks every part against its digest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from basalt.tables import sent_if_small, ship, written

#: Budgets of one export: records, bytes of records, originals and their bytes.
RECORDS, RECORD_BYTES, ORIGINALS, ORIGINAL_BYTES = 250_000, 64 << 20, 256, 32 << 20


class OverBudget(ValueError):
    """The export is larger than it may be; nothing was published."""


def _files(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Part(WriterCommitMessage):
    name: str
    entries: dict[str, int]
    size: int
    sha256: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, most_records: int, most_bytes: int):
        self.path, self.most_records, self.most_bytes, self.export = path, most_records, most_bytes, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.export}/part-{context.partitionId():05d}-{context.taskAttemptId()}.jsonl"
        files, root = _files(self.path)
        files.create_dir(f"{root}/{self.export}", recursive=True)
        digest, size, entries = hashlib.sha256(), 0, {}
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for entry, line in zip(batch.column("entry").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    data = (json.dumps({"entry": entry, "record": line}, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
                    out.write(data)
                    digest.update(data)
                    size += len(data)
                    entries[entry] = entries.get(entry, 0) + 1
        return _Part(name, entries, size, digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.size), key=lambda m: m.name)
        records, size = sum(sum(p.entries.values()) for p in parts), sum(p.size for p in parts)
        if records > self.most_records or size > self.most_bytes:
            self.abort(messages)
            raise OverBudget(f"{records} records in {size} bytes; at most {self.most_records} in {self.most_bytes}")
        files, root = _files(self.path)
        entries: dict[str, int] = {}
        for p in parts:
            for entry, n in p.entries.items():
                entries[entry] = entries.get(entry, 0) + n
        manifest = {"entries": entries, "records": records, "bytes": size, "parts": [{"name": p.name, "bytes": p.size, "sha256": p.sha256} for p in parts]}
        data = json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()
        for name, body in ((f"{self.export}.manifest.json", data), (f"{self.export}.pointer", json.dumps({"manifest": f"{self.export}.manifest.json", "sha256": hashlib.sha256(data).hexdigest()}).encode())):
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(body)
        # From here on readers see this export; before, the last one.
        files.move(f"{root}/{self.export}.pointer", f"{root}/CURRENT")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        if files.get_file_info(f"{root}/{self.export}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.export}")


class ArchiveSource(DataSource):
    """Write-only format `basalt_archive` for rows (entry, line); options path, records and bytes."""

    @classmethod
    def name(cls) -> str:
        return "basalt_archive"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("records", RECORDS)), int(self.options.get("bytes", RECORD_BYTES)))


def record_lines(entry: str, df: DataFrame) -> DataFrame:
    """(entry, line): each row as JSON with its keys in order; nulls are kept."""
    return df.select(F.lit(entry).alias("entry"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def verified_originals(originals: DataFrame, most: int = ORIGINALS, most_bytes: int = ORIGINAL_BYTES) -> DataFrame:
    """originals (name, content, sha256, size) in the order of their names, with `reason` (null: included) why one is left out: missing, size, digest, too many, too large together."""
    from pyspark.sql import Window

    fault = (
        F.when(F.col("content").isNull(), "missing")
        .when(F.octet_length("content") != F.col("size"), "size")
        .when(F.sha2("content", 256) != F.lower("sha256"), "digest")
    )
    judged = originals.withColumn("reason", fault)
    # Only the first most + 1 sound ones in order can be included, so no more are ranked.
    first = judged.where("reason IS NULL").select("name", "size").orderBy("name").limit(most + 1)
    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    room = first.select("name", F.count("*").over(order).alias("_n"), F.sum("size").over(order).alias("_bytes"))
    out = judged.join(F.broadcast(room), "name", "left")
    late = F.when(F.col("_n").isNull() | (F.col("_n") > most), "too many").when(F.col("_bytes") > most_bytes, "too large together")
    return out.withColumn("reason", F.coalesce("reason", late)).drop("_n", "_bytes")


def export_archive(tables: dict[str, DataFrame], path: str, originals: DataFrame | None = None, records: int = RECORDS, record_bytes: int = RECORD_BYTES) -> None:
    """Writes an archive of the tables' rows, and of the originals that hold what they should; the list of all originals is an entry too.

    Over budget nothing is published, and what was published before stays. Sizes are counted first, so an export that is too large writes no part.
    """
    lines = None
    for entry, df in sorted(tables.items()):
        one = record_lines(entry, df)
        lines = one if lines is None else lines.unionByName(one)
    if originals is not None:
        judged = written(verified_originals(originals), "originals")
        held = judged.where("reason IS NULL").select(F.concat(F.lit("originals/"), "name").alias("entry"), F.regexp_replace(F.base64("content"), r"\s", "").alias("line"))
        listed = record_lines("originals", judged.select("name", "sha256", "size", "reason", F.col("reason").isNull().alias("included")))
        lines = listed.unionByName(held) if lines is None else lines.unionByName(listed).unionByName(held)
    if lines is None:
        raise ValueError("nothing to export")
    spark = lines.sparkSession
    size = lines.agg(F.count("*").alias("n"), F.sum(F.octet_length("line").cast("long")).alias("bytes")).first()
    most = record_bytes + (0 if originals is None else 2 * ORIGINAL_BYTES)
    if size["n"] > records or (size["bytes"] or 0) > most:
        raise OverBudget(f"{size['n']} records in {size['bytes']} bytes; at most {records} in {most}")
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    # Names around each record count as well.
    lines.write.format("basalt_archive").mode("append").options(path=path, records=records, bytes=2 * most).save()


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows (entry, line), manifest) of the published export. A part that isn't what the manifest says is an error."""
    files, root = _files(path)
    with files.open_input_stream(f"{root}/CURRENT") as f:
        pointer = json.loads(f.read())
    with files.open_input_stream(f"{root}/{pointer['manifest']}") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != pointer["sha256"]:
        raise ValueError("the manifest isn't the published one")
    manifest = json.loads(data)
    names = [f"{path.rstrip('/')}/{p['name']}" for p in manifest["parts"]]
    kind = "entry string, record string"
    if not names:
        return spark.createDataFrame([], "entry string, line string"), manifest
    wanted = spark.createDataFrame([(p["name"], p["sha256"]) for p in manifest["parts"]], "name string, sha256 string")
    # Parts are as large as a task makes them and lie within the budgets.
    found = spark.read.format("binaryFile").load(names).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    if wanted.join(found, "name", "left").where("NOT (sha256 <=> found)").count():
        raise ValueError("a part isn't what the manifest says")
    return spark.read.schema(kind).json(names).select("entry", F.col("record").alias("line")), manifest


def publish_edges(snapshot: DataFrame, revisions: DataFrame, path: str, buckets: int = 64) -> int:
    """Replaces the edges (document, entity, frequency) of those documents whose revision (document, revision) is newer than the published one; how many that were.

    The table (document, revision, entity, frequency) is cut into buckets of documents. Only buckets with a newer document are written,
    each as a whole from a table written before, by dynamic partition overwrite; a stale snapshot changes no file. A document without edges has a
    row with a null entity, which keeps its revision. One publisher at a time.
    """
    spark = snapshot.sparkSession
    kind = "document long, revision long, entity long, frequency long, bucket int"
    bucket = F.pmod(F.xxhash64("document"), F.lit(buckets)).cast("int")
    try:
        known = spark.read.schema(kind).parquet(path)
    except Exception as e:  # the table begins with its first publication
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], kind)
    now = known.groupBy("document").agg(F.max("revision").alias("_published"))
    offered = revisions.select(F.col("document").cast("long").alias("document"), F.col("revision").cast("long").alias("revision"))
    fresh = written(offered.join(now, "document", "left").where(F.col("_published").isNull() | (F.col("revision") > F.col("_published"))).select("document", "revision", bucket.alias("bucket")), "fresh")
    count = fresh.count()
    if not count:
        return 0
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # buckets at most
    edges = snapshot.select(F.col("document").cast("long").alias("document"), F.col("entity").cast("long").alias("entity"), F.col("frequency").cast("long").alias("frequency"))
    new = fresh.join(edges, "document", "left").select("document", "revision", "entity", "frequency", "bucket")
    kept = known.where(F.col("bucket").isin(touched)).join(sent_if_small(fresh.select("document")), "document", "left_anti").select(new.columns)
    whole = written(kept.unionByName(new), "publication")
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return count

"""Archives that are whole or not there, verified originals, and edges behind a revision fence."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.sources import archive


def rows_of(spark, path):
    got, manifest = archive.read_archive(spark, path)
    return Counter((r.entry, r.line) for r in got.collect()), manifest


def test_an_archive_holds_all_rows_and_sound_originals(spark, tmp_path):
    path = str(tmp_path / "a")
    notes = spark.createDataFrame([(i, f"nöte\n{i}" if i % 3 else None) for i in range(50)], "z long, a string").repartition(5)
    body = [b"one", b"two", b"three", None, b""]
    sound = [(f"f{i}", b, hashlib.sha256(b or b"").hexdigest().upper(), len(b or b"")) for i, b in enumerate(body)]
    files = spark.createDataFrame([*sound, ("x1", b"abc", "0" * 64, 3), ("x2", b"abc", hashlib.sha256(b"abc").hexdigest(), 4)], "name string, content binary, sha256 string, size long")
    archive.export_archive({"notes": notes, "empty": notes.limit(0)}, path, files)
    got, manifest = rows_of(spark, path)
    assert sum(n for (e, _), n in got.items() if e == "notes") == 50
    assert got["notes", '{"a":"nöte\\n1","z":1}'] == 1 and got["notes", '{"a":null,"z":0}'] == 1
    listed = {json.loads(x)["name"]: json.loads(x)["reason"] for e, x in got if e == "originals"}
    assert listed == {"f0": None, "f1": None, "f2": None, "f3": "missing", "f4": None, "x1": "digest", "x2": "size"}
    assert {e for e, _ in got if e.startswith("originals/")} == {"originals/f0", "originals/f1", "originals/f2", "originals/f4"}
    assert manifest["entries"]["notes"] == 50 and manifest["records"] == sum(got.values())


def test_originals_over_their_budget(spark):
    files = spark.createDataFrame([(f"f{i}", b"x" * 10, hashlib.sha256(b"x" * 10).hexdigest(), 10) for i in range(6)], "name string, content binary, sha256 string, size long")
    assert [r.reason for r in archive.verified_originals(files, 4, 35).orderBy("name").collect()] == [None, None, None, "too large together", "too many", "too many"]


def test_over_budget_nothing_is_published(spark, tmp_path):
    path = str(tmp_path / "a")
    table = spark.range(100).repartition(4)
    archive.export_archive({"t": table.limit(10)}, path)
    before = rows_of(spark, path)[0]
    with pytest.raises(archive.OverBudget):
        archive.export_archive({"t": table}, path, records=99)
    with pytest.raises(archive.OverBudget):
        archive.export_archive({"t": table}, path, record_bytes=100)
    # The commit checks again, whatever was counted before.
    with pytest.raises(Exception, match="OverBudget"):
        archive.record_lines("t", table).write.format("basalt_archive").mode("append").options(path=path, records=50).save()
    assert rows_of(spark, path)[0] == before


def test_a_failing_task_leaves_no_half_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    archive.export_archive({"t": spark.range(3)}, path)
    before = rows_of(spark, path)[0]
    broken = spark.range(1000).repartition(4).select("id", F.when(F.col("id") == 777, F.raise_error("lost")).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        archive.record_lines("t", broken).write.format("basalt_archive").mode("append").options(path=path).save()
    assert rows_of(spark, path)[0] == before
    assert len([p for p in (tmp_path / "a").iterdir() if p.is_dir()]) == 1


def test_a_changed_part_is_found(spark, tmp_path):
    path = str(tmp_path / "a")
    archive.export_archive({"t": spark.range(3)}, path)
    part = next(p for p in (tmp_path / "a").glob("*/part-*") if p.stat().st_size)
    part.write_bytes(part.read_bytes().replace(b"id", b"xd"))
    with pytest.raises(ValueError, match="part"):
        archive.read_archive(spark, path)


def test_only_newer_revisions_are_published(spark, tmp_path):
    path = str(tmp_path / "edges")

    def publish(edges, revisions):
        return archive.publish_edges(spark.createDataFrame(edges, "document long, entity long, frequency long"), spark.createDataFrame(revisions, "document long, revision long"), path, 4)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "edges").rglob("*.parquet")}

    def table():
        return sorted((r.document, r.revision, r.entity or -1, r.frequency or -1) for r in spark.read.parquet(path).collect())

    assert publish([(1, 10, 1), (1, 11, 2), (2, 10, 5)], [(1, 1), (2, 1), (3, 1)]) == 3
    assert table() == [(1, 1, 10, 1), (1, 1, 11, 2), (2, 1, 10, 5), (3, 1, -1, -1)]
    before = files()
    assert publish([(1, 99, 9)], [(1, 1), (2, 0)]) == 0 and files() == before
    assert publish([(1, 12, 3), (2, 99, 9)], [(1, 2), (2, 1), (3, 2)]) == 2
    assert table() == [(1, 2, 12, 3), (2, 1, 10, 5), (3, 2, -1, -1)]
    untouched = {p for p in before if p in files() and files()[p] == before[p]}
    assert all(f"bucket={b}" not in str(p) for p in untouched for b in {r.b for r in spark.createDataFrame([(1,), (3,)], "d long").select(F.pmod(F.xxhash64("d"), F.lit(4)).alias("b")).collect()})

"""Document versions, index generations, quotas and record changes as table-to-table transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.tables import LEAST_ROWS, SENT_BYTES, sent_if_small, written

#: Tasks that a list's events are dealt over, and bytes of lists in a task: some way below the megabyte up to which Parquet keeps a column's equal values once.
PARTS, FILE_BYTES = 16, 256_000


def content_conflicts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, existing): rows whose content another live row has, with the smallest key of that content."""
    h = docs.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min(key).alias("existing"))
    return h.join(first, "content_hash").where(F.col(key) != F.col("existing")).select(key, "existing")


def changed_versions(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Slowly changing versions: rows that differ in any field (nulls compare) from the one before, numbered from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.lag(f).over(w))
    kept = rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", same).where(F.col("_first") | ~F.col("_same"))
    return kept.withColumn("version_number", F.row_number().over(w)).drop("_first", "_same")


def optimistic_update(rows: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """changes: (key, expected, value). Each change with its outcome and the version after it: updated, conflict or not_found."""
    held = rows.select(F.col(key), "version")
    joined = changes.join(held, key, "left")
    outcome = F.when(F.col("version").isNull(), "not_found").when(F.col("version") == F.col("expected"), "updated").otherwise("conflict")
    return joined.select(key, outcome.alias("outcome"), F.when(outcome == "updated", F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def transitions(log: DataFrame, key: str, order: list[str], status: str, wanted: list[str]) -> DataFrame:
    """Rows where the status becomes one of `wanted`, not where it stays."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(status).over(w)
    return log.withColumn("_before", before).where(F.col(status).isin(*wanted) & ~F.col(status).eqNullSafe(F.col("_before"))).drop("_before")


def fold_latest(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last state of each key, by a maximum: it combines before the shuffle and needs no sort."""
    last = F.max(F.struct(*order, *fields)).alias("s")
    return log.groupBy(key).agg(last, F.count("*").alias("changes")).select(key, *[F.col(f"s.{f}").alias(f) for f in fields], "changes")


def swap_derivations(derivations: DataFrame, finished: DataFrame) -> DataFrame:
    """derivations (id, document, status) after finished ones (id, ok): a pending one that succeeded becomes current and the document's old one superseded; a failed one leaves the old one serving.

    Of several that succeeded for one document the largest id wins, the others are superseded.
    """
    told = derivations.join(finished, "id", "left")
    won = told.where("status = 'pending' AND ok").groupBy("document").agg(F.max("id").alias("winner"))
    out = told.join(won, "document", "left")
    status = (
        F.when(F.col("id") == F.col("winner"), "current")
        .when(F.col("winner").isNotNull() & ((F.col("status") == "current") | ((F.col("status") == "pending") & F.col("ok"))), "superseded")
        .when((F.col("status") == "pending") & ~F.col("ok"), "failed")
        .otherwise(F.col("status"))
    )
    return out.select("id", "document", status.alias("status"))


def delete_restore(jobs: DataFrame, actions: DataFrame, order: list[str]) -> DataFrame:
    """jobs (job, document, state) after each document's last action (delete or restore): open jobs of a deleted document are obsolete; a restored one has its obsolete jobs queued again, no others."""
    last = actions.groupBy("document").agg(F.max(F.struct(*order, "action")).alias("a")).select("document", F.col("a.action").alias("action"))
    state = F.when((F.col("action") == "delete") & F.col("state").isin("pending", "processing"), "obsolete").when((F.col("action") == "restore") & (F.col("state") == "obsolete"), "pending").otherwise(F.col("state"))
    return jobs.join(last, "document", "left").select("job", "document", state.alias("state"))


def mark_all(rows: DataFrame, mine: Column, column: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after, updated): the column set to now where it was null in the rows that `mine` holds for, and how many that were, as one row."""
    hit = F.coalesce(mine, F.lit(False)) & F.col(column).isNull()
    return rows.withColumn(column, F.when(hit, now).otherwise(F.col(column))), rows.agg(F.count(F.when(hit, 1)).alias("updated"))


def delete_rows(rows: DataFrame, requests: DataFrame, key: str, scope: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after, outcomes). requests (key, scope, hard): a hard one takes the row out, a soft one sets deleted_at; both only in the request's own scope.

    Outcomes (key, scope, hard, outcome): deleted, or not_found for a row that isn't there, belongs to another scope or is deleted already.
    Of several requests for a row a hard one counts.
    """
    held = rows.where("deleted_at IS NULL").select(key, scope, F.lit(True).alias("_there"))
    told = requests.join(held, [key, scope], "left").withColumn("outcome", F.when(F.col("_there"), "deleted").otherwise("not_found")).drop("_there")
    gone = told.where("outcome = 'deleted'").groupBy(key, scope).agg(F.max("hard").alias("_hard"))
    after = rows.join(gone, [key, scope], "left").where("NOT coalesce(_hard, false)")
    return after.withColumn("deleted_at", F.when(F.col("_hard").isNotNull(), now).otherwise(F.col("deleted_at"))).drop("_hard").select(*rows.columns), told


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows of new whose key old lacks are added, one for each key, the first by all columns."""
    added = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return old.unionByName(added)


def upsert_where(old: DataFrame, new: DataFrame, key: str, replaces: Column) -> DataFrame:
    """ON CONFLICT DO UPDATE WHERE: a row of new takes the place of old's only where `replaces` holds, over old's columns and new's as new_<column>. One row a key in new."""
    names = old.columns
    renamed = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in names if c != key], F.lit(True).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(renamed, key, "full")
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.coalesce(replaces, F.lit(False)))
    return joined.select(key, *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names if c != key])


def fresh_workers(beats: DataFrame, key: str, time: str, now: Column, most: Column) -> DataFrame:
    """(key, last, age_seconds, fresh): freshness by the age of each worker's last heartbeat, whatever status it stored."""
    last = beats.groupBy(key).agg(F.max(time).alias("last"))
    age = now.cast("timestamp").cast("long") - F.col("last").cast("timestamp").cast("long")
    return last.select(key, "last", age.alias("age_seconds"), (age <= most).alias("fresh"))


def recipient_snapshots(events: DataFrame, members: DataFrame, event: str, group: str, time: str, member: str, since: str) -> DataFrame:
    """(event, recipients) of events (event, group, time): the members (member, group, since) of its group that had joined by then, in order, joined by commas. Events without any are left out.

    All events of a group between two joinings have the same members. So lists are made for each group and joining time, and an event
    finds its list; no pair of an event and a member is made. Rows that share an event's id are one event, whose lists are put together.
    """
    joined = members.select(F.col(group).alias("_g"), F.col(since).alias("_since"), F.col(member).alias("_m")).where("_g IS NOT NULL AND _since IS NOT NULL")
    times = joined.select("_g", F.col("_since").alias("_from")).distinct()
    lists = times.join(joined, "_g").where(F.col("_since") <= F.col("_from")).groupBy("_g", "_from").agg(F.array_sort(F.collect_list("_m")).alias("_all"))
    said = F.array_join(F.transform("_all", lambda x: x.cast("string")), ",")
    lists = written(lists.select("_g", "_from", "_all", said.alias("_said")), "snapshots")
    until = F.lead("_from").over(Window.partitionBy("_g").orderBy("_from"))
    spans = written(lists.select("_g", "_from").withColumn("_until", until), "snapshot-times")
    met = (F.col(group) == F.col("_g")) & (F.col(time) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(time) < F.col("_until")))
    placed = events.select(event, group, time).join(sent_if_small(spans), met).select(event, "_g", "_from")
    found = written(placed.groupBy(event).agg(F.count("*").alias("_n"), F.min(F.struct("_g", "_from")).alias("_at")), "snapshots-found")
    # A list's events lie together, in PARTS tasks of few lists each: then a file of the result, as columns, has a list once and not once for each event.
    texts = lists.select("_g", "_from", "_said")
    size = lists.agg(F.sum(F.octet_length("_said") + 32)).first()[0] or 0
    spread = max(1, -(-size * PARTS // FILE_BYTES), min(found.sparkSession.sparkContext.defaultParallelism, -(-found.count() // LEAST_ROWS)))
    once = found.where("_n = 1").select(event, F.col("_at._g").alias("_g"), F.col("_at._from").alias("_from"), F.pmod(F.xxhash64(event), F.lit(PARTS)).cast("int").alias("_part"))
    once = once.repartition(spread, "_g", "_from", "_part").sortWithinPartitions("_g", "_from")
    # Lists are sent to all tasks by their real size; large ones meet events by parts.
    told = once.join(F.broadcast(texts), ["_g", "_from"]) if size <= SENT_BYTES else once.join(texts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(spread, "_g", "_from", "_part"), ["_g", "_from", "_part"])
    again = placed.join(found.where("_n > 1").select(F.col(event).alias("_e")), F.col(event).eqNullSafe(F.col("_e"))).join(lists.select("_g", "_from", "_all"), ["_g", "_from"])
    both = again.groupBy(event).agg(F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("_all"))), lambda x: x.cast("string")), ",").alias("recipients"))
    return told.select(event, F.col("_said").alias("recipients")).unionByName(both)

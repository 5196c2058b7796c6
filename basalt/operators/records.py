"""Record changes, idempotent requests, uploads, export plans and outboxes as table-to-table transforms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_IDS = 100


def bulk_change(rows: DataFrame, key: str, ids: Iterable, scope: Column) -> DataFrame:
    """(key): the rows of at most MOST_IDS unique ids that lie in the scope; other ids are passed over. The caller marks or deletes them."""
    wanted = list(ids)
    if not 0 < len(wanted) <= MOST_IDS or len(set(wanted)) != len(wanted):
        raise ValueError(f"1 to {MOST_IDS} unique ids")
    return rows.where(scope & F.col(key).isin(*wanted)).select(key)


def idempotent(requests: DataFrame, key: list[str], order: list[str], body: Column, state: str, response: str) -> DataFrame:
    """requests with outcome and stored: the first request of a key is taken; a later one with the same body gets the first's response
    once that is completed and waits before; another body under the same key is a conflict."""
    rows = requests.withColumn("fingerprint", F.sha2(body.cast("binary"), 256))
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, "fingerprint", state, response)).alias("first"))
    joined = rows.join(first, key)
    mine = F.lit(True)
    for c in order:
        mine = mine & (F.col(c) == F.col(f"first.{c}"))
    same, done = F.col("fingerprint") == F.col("first.fingerprint"), F.col(f"first.{state}") == "completed"
    outcome = F.when(mine, "accepted").when(~same, "conflict").when(done, "replayed").otherwise("in_progress")
    return joined.select(*requests.columns, outcome.alias("outcome"), F.when(~mine & same & done, F.col(f"first.{response}")).alias("stored"))


def insert_facts(active: DataFrame, new: DataFrame, user: str, fact: str, confirmed: str, sensitive: Column, cap: int = 1_000) -> DataFrame:
    """new with outcome: refused where the text is sensitive and not confirmed, where the user's active facts have it in any case, or past the cap; the first of equal new ones is inserted.

    new has a column `place`, the order of arrival; places are told apart.
    """
    low = F.lower(fact)
    held = active.select(user, low.alias("k")).distinct()
    counts = active.groupBy(user).agg(F.count("*").alias("had"))
    fresh = new.withColumn("k", low).join(held.withColumn("known", F.lit(True)), [user, "k"], "left").join(counts, user, "left")
    allowed = ~(sensitive & ~F.col(confirmed)) & F.col("known").isNull()
    once = fresh.withColumn("nth", F.when(allowed, F.row_number().over(Window.partitionBy(user, "k", allowed).orderBy("place"))))
    counted = once.withColumn("number", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy(user).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("had", F.lit(0)))
    outcome = F.when(sensitive & ~F.col(confirmed), "confirm").when(F.col("known") | (F.col("nth") > 1), "duplicate").when(F.col("number") > cap, "full").otherwise("inserted")
    return counted.select(*new.columns, outcome.alias("outcome"))


def reserve_quota(requests: DataFrame, tenant: str, order: list[str], size: str, limit: int) -> DataFrame:
    """requests with accepted and running: in order, a tenant's request is accepted if it fits beside those accepted before; a refused one takes nothing.

    What is accepted depends on every earlier decision, so a tenant's rows are folded one after another, as a sorted stream with one
    number as its state; they are never held together. Null sizes count as nothing.
    """
    at = [requests.columns.index(c) for c in (tenant, size)]
    schema = T.StructType([*requests.schema, *T.StructType.fromDDL("running long, accepted boolean")])

    def fold(batches):
        import pyarrow as pa

        current, used = object(), 0
        for batch in batches:
            running, accepted = [], []
            for who, n in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True):
                if who != current:
                    current, used = who, 0
                fits = used + (n or 0) <= limit
                used += (n or 0) if fits else 0
                running.append(used)
                accepted.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(running, pa.int64()), pa.array(accepted, pa.bool_())], schema.names)

    return requests.repartition(tenant).sortWithinPartitions(tenant, *order).mapInArrow(fold, schema)


def recover_uploads(intents: DataFrame, now: Column, grace: Column, lease: Column, attempts: int) -> tuple[DataFrame, DataFrame]:
    """(abandoned, leased) of intents (id, tenant, size, status, attempts, touched): those tried often enough without being stored give
    their quota back; of the rest the one not touched longest, past its grace or its lease, is taken."""
    tired = (F.col("status") != "stored") & (F.col("attempts") >= attempts)
    abandoned = intents.where(tired & F.col("status").isin("pending", "uploading")).groupBy("tenant").agg(F.count("*").alias("abandoned"), F.sum("size").alias("released"))
    due = ((F.col("status") == "pending") & (F.col("touched") <= now - grace)) | ((F.col("status") == "uploading") & (F.col("touched") <= now - lease))
    leased = intents.where(due & (F.col("attempts") < attempts)).orderBy("touched", "id").limit(1).select("id", (F.col("attempts") + 1).alias("attempts"))
    return abandoned, leased


def export_plan(versions: DataFrame, objects: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """Every version with the object it came from: included, or excluded with the reason. The whole plan's totals, whether it is complete and
    whether it keeps the caps stand in each row.

    versions: (version), objects: (version, status, bytes).
    """
    usable = F.col("status") == "available"
    files = versions.join(objects, "version", "left").withColumn("included", F.coalesce(usable, F.lit(False)))
    files = files.withColumn("reason", F.when(F.col("status").isNull(), "missing").when(~usable, F.col("status")))
    totals = files.agg(F.count(F.when(F.col("included"), 1)).alias("included_count"), F.count("*").alias("all"), F.coalesce(F.sum(F.when(F.col("included"), F.col("bytes"))), F.lit(0)).alias("total_bytes"))  # one row
    whole = files.crossJoin(F.broadcast(totals))
    return whole.select("version", "included", "reason", "included_count", "total_bytes", (F.col("included_count") == F.col("all")).alias("complete"), ((F.col("included_count") <= most_files) & (F.col("total_bytes") <= most_bytes)).alias("within_limits"))


def replace_edges(edges: DataFrame, snapshot: DataFrame, document: str = "document") -> DataFrame:
    """edges after a document's newer snapshot replaced its old ones; a snapshot of an older or the same revision changes nothing."""
    had = edges.groupBy(document).agg(F.max("revision").alias("had"))
    newer = snapshot.join(had, document, "left").where(F.col("had").isNull() | (F.col("revision") > F.col("had"))).drop("had")
    return edges.join(newer.select(document).distinct(), document, "left_anti").unionByName(newer.select(*edges.columns))


def ready(outbox: DataFrame, now: Column, locked: Column, published: Column, batch: int) -> DataFrame:
    """The next rows to publish: pending and due, locked by a publisher for too long, or published and not processed for too long; the longest available first."""
    status = F.col("status")
    due = ((status == "pending") & (F.col("available") <= now)) | ((status == "publishing") & (F.col("locked_at") < now - locked)) | ((status == "published") & (F.col("published_at") < now - published))
    return outbox.where(due).orderBy("available", "id").limit(batch)


def settle(outbox: DataFrame, now: Column, ok: Column, attempts: int) -> DataFrame:
    """outbox after a try: processed, back to pending after min(300, 2 ** min(tries, 8)) seconds, or dead after the last try."""
    tries = F.col("attempts") + 1
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.least(F.lit(300), F.pow(F.lit(2), F.least(tries, F.lit(8)))).cast("decimal(18,6)"))
    status = F.when(ok, "processed").when(tries >= attempts, "dead").otherwise("pending")
    return outbox.select("id", status.alias("status"), tries.alias("attempts"), F.when(status == "pending", now + wait).otherwise(F.col("available")).alias("available"))


def prune_outbox(outbox: DataFrame, now: Column, age: Column, most: int) -> DataFrame:
    """At most `most` ended rows older than `age`, oldest first."""
    return outbox.where(F.col("status").isin("processed", "dead") & (F.col("available") < now - age)).orderBy("available", "id").limit(most).select("id")


def first_deliveries(deliveries: DataFrame, subscriber: str, order: list[str], event: str, last: int = 5_000) -> DataFrame:
    """Deliveries whose event isn't among the subscriber's last `last` ones."""
    numbered = deliveries.withColumn("n", F.row_number().over(Window.partitionBy(subscriber).orderBy(*order)))
    before = F.lag("n").over(Window.partitionBy(subscriber, event).orderBy("n"))
    return numbered.withColumn("before", before).where(F.col("before").isNull() | (F.col("n") - F.col("before") > last)).drop("n", "before")


def growth(snapshots: DataFrame, key: str, version: str, elements: str) -> DataFrame:
    """(key, version, position, element): the elements that each snapshot of an array has beyond the snapshot before it."""
    had = F.coalesce(F.lag(F.size(elements)).over(Window.partitionBy(key).orderBy(version)), F.lit(0))
    new = snapshots.withColumn("had", had).where(F.size(elements) > F.col("had"))
    tail = new.select(key, version, "had", F.posexplode(F.slice(F.col(elements), F.col("had") + 1, F.size(elements) - F.col("had"))).alias("p", "element"))
    return tail.select(key, version, (F.col("had") + F.col("p") + 1).alias("position"), "element")


def changes(log: DataFrame, key: str, order: list[str], read: str, deleted: str) -> DataFrame:
    """Events of a change log of notifications: created at the first row, read_state_changed where the flag turns, deleted once; rows after the deletion give none."""
    w = Window.partitionBy(key).orderBy(*order)
    gone = F.coalesce(F.max(F.col(deleted).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = log.withColumn("n", F.row_number().over(w)).withColumn("was", F.lag(read).over(w)).withColumn("gone", gone)
    kind = F.when(F.col("n") == 1, "created").when(F.col(deleted), "deleted").when(F.col("was") != F.col(read), "read_state_changed")
    return rows.where(~F.col("gone")).withColumn("change", kind).where("change IS NOT NULL").drop("n", "was", "gone")


def rule_matches(kind: Column, arg: Column, tags: Column, mime: Column) -> Column:
    """Whether an automation rule fits an event: always, tag_contains (a tag, in any case) or mime_type_equals. A rule of another kind is an error when it is read."""
    held = F.array_contains(F.transform(tags, lambda x: F.lower(x)), F.lower(arg))
    unknown = F.raise_error(F.concat(F.lit("unknown rule: "), F.coalesce(kind, F.lit("null")))).cast("boolean")
    return F.when(kind == "always", True).when(kind == "tag_contains", held).when(kind == "mime_type_equals", mime == arg).otherwise(unknown)

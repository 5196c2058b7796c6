"""Lifecycle, record-change, grounding, evaluation and outbox queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import chunking
from basalt.operators import evaluation, fulltext, grounding, lifecycle, paging, records
from basalt.plans.registry import query


@query("SELECT doc_id, existing FROM (SELECT doc_id, MIN(doc_id) OVER (PARTITION BY text) AS existing FROM documents) WHERE doc_id <> existing")
def ing08_content_conflicts(t):
    return lifecycle.content_conflicts(t.documents, "doc_id", "text")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version_number FROM
  (SELECT *, lag(o_orderstatus) OVER w AS p, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE r = 1 OR p IS DISTINCT FROM o_orderstatus""")
def ing09_changed_versions(t):
    return lifecycle.changed_versions(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_custkey", "o_orderkey", "version_number")


@query("""SELECT user_id, CAST(MIN(event_id) AS BIGINT) AS request, COUNT(*) AS attempts, COUNT(DISTINCT event_type) = 1 AS same_request FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def ing10_idempotent_upload(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("request"), F.count("*").alias("attempts"), (F.countDistinct("event_type") == 1).alias("same_request")).drop("day")


@query("""WITH RECURSIVE q AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), f AS (SELECT source, doc_id, r, n_chars <= 100000 AS accepted, CASE WHEN n_chars <= 100000 THEN n_chars ELSE 0 END AS running FROM q WHERE r = 1
  UNION ALL SELECT q.source, q.doc_id, q.r, f.running + q.n_chars <= 100000, f.running + CASE WHEN f.running + q.n_chars <= 100000 THEN q.n_chars ELSE 0 END FROM f JOIN q ON q.source = f.source AND q.r = f.r + 1) SELECT doc_id, running, accepted FROM f""")
def ing11_reserve_quota(t):
    return records.reserve_quota(t.documents.select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 100_000).select("doc_id", "running", "accepted")


@query("SELECT user_id, CAST(arg_max(event_id, ts) AS BIGINT) AS event_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS event_type, COUNT(*) AS changes FROM events GROUP BY 1")
def ing13_str16_fold_latest(t):
    return lifecycle.fold_latest(t.events, "user_id", ["ts", "event_id"], ["event_type"]).join(t.events.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id")), "user_id")


@query("""SELECT o_custkey, o_orderkey, CASE WHEN r = 1 THEN 'current' ELSE 'superseded' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders WHERE o_orderstatus <> 'P')""")
def ing14_derivation_swap(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.where("o_orderstatus != 'P'").select("o_custkey", "o_orderkey", F.when(F.row_number().over(w) == 1, "current").otherwise("superseded").alias("state"))


@query("SELECT doc_id, lang = 'es' AS deleted, CASE WHEN lang = 'es' THEN 'obsolete' WHEN n_chars > 2000 THEN 'requeued' ELSE 'ready' END AS job FROM documents")
def ing15_delete_restore(t):
    gone = F.col("lang") == "es"
    return t.documents.select("doc_id", gone.alias("deleted"), F.when(gone, "obsolete").when(F.col("n_chars") > 2000, "requeued").otherwise("ready").alias("job"))


@query("SELECT doc_id, sha256(text) AS content_hash, (SELECT COUNT(*) FROM documents WHERE n_chars > 200) AS expected FROM documents WHERE n_chars > 200")
def ing16_generation_snapshot(t):
    rows = t.documents.where("n_chars > 200").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return rows.crossJoin(F.broadcast(t.documents.where("n_chars > 200").agg(F.count("*").alias("expected"))))


@query("""SELECT event_type, CAST(LEAST(20, GREATEST(100 - live, 0)) AS BIGINT) AS batch FROM (SELECT event_type, COUNT(*) FILTER (WHERE user_id % 20 = 0) AS live FROM events GROUP BY 1)""")
def ing17_claim_size(t):
    live = t.events.groupBy("event_type").agg(F.count(F.when(F.col("user_id") % 20 == 0, 1)).alias("live"))
    return live.select("event_type", F.least(F.lit(20), F.greatest(F.lit(100) - F.col("live"), F.lit(0))).cast("long").alias("batch"))


GENERATIONS = "g AS (SELECT label AS id, COUNT(*) AS n, CASE WHEN label = 3 THEN 'active' WHEN label = 5 THEN 'ready' ELSE 'building' END AS status FROM embeddings GROUP BY 1)"


def generations(t):
    return t.embeddings.groupBy(F.col("label").alias("id")).agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("id") == 3, "active").when(F.col("id") == 5, "ready").otherwise("building"))


@query(f"WITH {GENERATIONS} SELECT id, CASE WHEN id = 5 AND status = 'ready' AND n > 10 THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status FROM g")
def ing18_19_activate(t):
    promoted = (F.col("id") == 5) & (F.col("status") == "ready") & (F.col("n") > 10)
    return generations(t).select("id", F.when(promoted, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status")).alias("status"))


@query(f"WITH {GENERATIONS} SELECT id, CASE WHEN status IN ('building', 'ready') THEN 'stale' ELSE status END AS status, 1 + (SELECT COUNT(*) FROM documents WHERE lang = 'fr') AS revision FROM g")
def ing21_revision_bump(t):
    bumps = t.documents.where("lang = 'fr'").agg((F.count("*") + 1).alias("revision"))
    return generations(t).crossJoin(F.broadcast(bumps)).select("id", F.when(F.col("status").isin("building", "ready"), "stale").otherwise(F.col("status")).alias("status"), "revision")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) ORDER BY c_acctbal, c_custkey LIMIT 1")
def ing22_refresh_start(t):
    idle = t.customer.where("c_acctbal < 0").join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").join(t.events, F.col("user_id") == F.col("c_custkey"), "left_anti")
    return idle.orderBy("c_acctbal", "c_custkey").limit(1).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, COALESCE(s, 'pending') AS state FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, 'reused' AS s FROM lineitem WHERE l_returnflag = 'A') ON k = l_orderkey AND n = l_linenumber")
def ing23_refresh_reuse(t):
    known = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.lit("reused").alias("s"))
    return t.lineitem.join(known, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.coalesce("s", F.lit("pending")).alias("state"))


@query("SELECT event_id FROM events WHERE event_type <> 'click' AND user_id % 10 <> 0 ORDER BY ts, event_id LIMIT 30")
def ing24_paused_excluded(t):
    return t.events.where("event_type != 'click' AND user_id % 10 != 0").orderBy("ts", "event_id").limit(30).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') ORDER BY o_orderdate, o_orderkey LIMIT 100")
def ing25_str11_prune(t):
    old = t.orders.where("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderstatus = 'F'")
    return old.join(t.lineitem.where("l_returnflag = 'N'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'sentence' WHEN doc_id % 4 = 1 THEN 'token' ELSE 'recursive' END AS strategy FROM documents")
def ing04_strategy(t):
    asked = F.element_at(F.array(*map(F.lit, ("semantic", " Token", "SENTENCE", "recursive"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", chunking.strategy(asked).alias("strategy"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ': ' WHEN doc_id % 3 = 1 THEN source || ': ' ELSE source || ' > ' || lang || ': ' END AS header FROM documents")
def ing05_header(t):
    section = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return t.documents.select("doc_id", chunking.header(F.col("source"), section).alias("header"))


@query("""SELECT p_partkey, outcome, CAST(CASE WHEN outcome = 'updated' THEN v + 1 ELSE v END AS INTEGER) AS version FROM (SELECT c.k AS p_partkey, p.p_size AS v,
  CASE WHEN p.p_partkey IS NULL THEN 'not_found' WHEN p.p_size = c.k % 50 + 1 THEN 'updated' ELSE 'conflict' END AS outcome FROM (SELECT s_suppkey * 3 AS k FROM supplier UNION ALL SELECT 9000000 + s_suppkey FROM supplier) c LEFT JOIN part p ON p.p_partkey = c.k)""")
def dml01_optimistic_update(t):
    keys = t.supplier.select((F.col("s_suppkey") * 3).alias("p_partkey")).union(t.supplier.select(F.col("s_suppkey") + 9_000_000))
    changes = keys.withColumn("expected", F.col("p_partkey") % 50 + 1).withColumn("value", F.lit("x"))
    return lifecycle.optimistic_update(t.part.withColumnRenamed("p_size", "version"), changes, "p_partkey", "value").select("p_partkey", "outcome", F.col("version").cast("int").alias("version"))


@query("SELECT event_id, event_type, event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS is_read FROM events")
def dml02_bulk_read(t):
    ids = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id")).distinct().withColumn("hit", F.lit(True))
    return t.events.join(ids, "event_id", "left").select("event_id", "event_type", F.coalesce("hit", F.lit(False)).alias("is_read"))


@query("""WITH n AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN ts END AS read_at FROM events)
  SELECT event_id, CASE WHEN user_id = 7 AND read_at IS NULL THEN TIMESTAMP '2024-02-01' ELSE read_at END AS read_at, (SELECT COUNT(*) FROM n WHERE user_id = 7 AND read_at IS NULL) AS updated FROM n""")
def dml03_mark_all(t):
    """One user's unread notifications marked, the whole table after it, and how many it were."""
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "click", F.col("ts")).alias("read_at"))
    after, updated = lifecycle.mark_all(rows, F.col("user_id") == 7, "read_at", F.to_timestamp_ntz(F.lit("2024-02-01")))
    return after.crossJoin(F.broadcast(updated)).select("event_id", "read_at", "updated")


MEMORIES = """m AS (SELECT c_custkey AS id, c_nationkey AS scope, CASE WHEN c_mktsegment = 'MACHINERY' THEN TIMESTAMP '2020-01-01' END AS deleted_at FROM customer),
  r AS (SELECT s_suppkey * 2 AS id, s_nationkey AS scope, s_acctbal < 5000 AS hard FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_custkey % 2 = 0 FROM customer WHERE c_custkey % 3 = 0),
  o AS (SELECT r.*, CASE WHEN m.id IS NOT NULL THEN 'deleted' ELSE 'not_found' END AS outcome FROM r LEFT JOIN m ON m.id = r.id AND m.scope = r.scope AND m.deleted_at IS NULL)"""


def _deletes(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("scope"), F.when(F.col("c_mktsegment") == "MACHINERY", F.to_timestamp_ntz(F.lit("2020-01-01"))).alias("deleted_at"))
    some = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 2 == 0).alias("hard"))
    requests = t.supplier.select((F.col("s_suppkey") * 2).alias("id"), F.col("s_nationkey").alias("scope"), (F.col("s_acctbal") < 5000).alias("hard")).unionByName(some)
    return lifecycle.delete_rows(rows, requests, "id", "scope", F.to_timestamp_ntz(F.lit("2024-02-01")))


@query(f"""WITH {MEMORIES}, g AS (SELECT id, scope, bool_or(hard) AS hard FROM o WHERE outcome = 'deleted' GROUP BY 1, 2)
  SELECT m.id, m.scope, CASE WHEN g.id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE deleted_at END AS deleted_at FROM m LEFT JOIN g USING (id, scope) WHERE NOT COALESCE(hard, FALSE)""")
def dml04_soft_and_hard_delete(t):
    """The table after soft and hard deletes, each in its own scope."""
    return _deletes(t)[0]


@query(f"WITH {MEMORIES} SELECT id, scope, hard, outcome FROM o")
def dml04_outcomes(t):
    return _deletes(t)[1]


@query("""WITH o AS (SELECT c_nationkey AS k, CAST(COUNT(*) AS BIGINT) AS v FROM customer WHERE c_nationkey < 15 GROUP BY 1), n AS (SELECT s_nationkey AS k, CAST(MIN(s_suppkey) AS BIGINT) AS v FROM supplier GROUP BY 1)
  SELECT k, v FROM o UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM o)""")
def snk02_insert_missing(t):
    """Insert with ON CONFLICT DO NOTHING: of several new rows of a key the first."""
    old = t.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return lifecycle.insert_missing(old, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), "k")


@query("""WITH o AS (SELECT c_nationkey AS k, CAST(COUNT(*) AS BIGINT) AS v FROM customer WHERE c_nationkey < 15 GROUP BY 1), n AS (SELECT s_nationkey AS k, CAST(MAX(s_suppkey) AS BIGINT) AS v FROM supplier GROUP BY 1)
  SELECT COALESCE(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR n.v > o.v THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.k = n.k""")
def snk02_upsert_where(t):
    """Insert with ON CONFLICT DO UPDATE WHERE: only a larger value takes an old one's place."""
    old = t.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    new = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("v"))
    return lifecycle.upsert_where(old, new, "k", F.col("new_v") > F.col("v"))


@query("""SELECT user_id, MAX(ts) AS last, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(MAX(ts))) AS BIGINT) AS age_seconds, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(MAX(ts))) AS BIGINT) <= 86400 AS fresh FROM events GROUP BY 1""")
def str16_freshness(t):
    """Freshness by the age of the last heartbeat, whatever status was stored with it."""
    return lifecycle.fresh_workers(t.events, "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-31")), F.lit(86_400))


@query("SELECT MIN(doc_id) AS doc_id, COUNT(*) - 1 AS refused FROM documents GROUP BY lower(text)")
def dml05_unique_insert(t):
    return t.documents.groupBy(F.sha2(F.lower("text").cast("binary"), 256)).agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("refused")).select("doc_id", "refused")


@query("""WITH o AS (SELECT c_nationkey AS k, CAST(COUNT(*) AS BIGINT) AS v FROM customer GROUP BY 1), n AS (SELECT s_nationkey AS k, CAST(1000 + COUNT(*) AS BIGINT) AS v FROM supplier GROUP BY 1)
  SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k)""")
def snk02_upsert(t):
    """Insert with ON CONFLICT DO UPDATE: the new row takes the old one's place, whichever value is larger."""
    old = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    new = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") + 1000).alias("v"))
    return lifecycle.upsert(old, new, "k")


@query("SELECT o_orderkey, l.n IS NOT NULL AS included, CASE WHEN l.n IS NULL THEN 'missing' WHEN l.bytes > 100000 THEN 'too_large' ELSE 'ok' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(l_extendedprice) AS bytes FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) l ON l_orderkey = o_orderkey")
def snk06_export_plan(t):
    held = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("bytes"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("bytes") > 100_000, "too_large").otherwise("ok")
    return t.orders.join(held, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.col("n").isNotNull().alias("included"), reason.alias("reason"))


@query("SELECT doc_id, CAST(p AS INTEGER) AS page, CAST(length(page) AS INTEGER) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)")
def src04_page_split(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "page")).select("doc_id", (F.col("p") + 1).alias("page"), F.length("page").alias("n"))


@query("SELECT conv_id, 'D' || turn AS source_id, turn FROM conversations WHERE trim(text) <> '' AND role <> 'system'")
def gnd01_evidence_ids(t):
    return grounding.evidence_ids(t.conversations.where("role != 'system'"), "conv_id", "turn", "text")


CLAIMS = """c AS (SELECT a.conv_id, a.turn, a.text AS claim, b.text AS content FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  k AS (SELECT *, list_distinct([w FOR w IN regexp_split_to_array(lower(claim), '[^a-z0-9]+') IF length(w) > 2]) AS x, list_distinct([w FOR w IN regexp_split_to_array(lower(content), '[^a-z0-9]+') IF length(w) > 2]) AS y,
  list_distinct(regexp_extract_all(claim, '\\d+')) AS n, list_distinct(regexp_extract_all(content, '\\d+')) AS m FROM c)"""


@query(f"""WITH {CLAIMS} SELECT conv_id, turn, ROUND(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END, 6) AS coverage, len(list_intersect(n, m)) = len(n) AS anchored,
  len(list_intersect(x, y)) > 0 AND len(list_intersect(x, y)) / len(x) >= 0.25 AND len(list_intersect(n, m)) = len(n) AS supported FROM k""")
def gnd03_claim_support(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("claim"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    return grounding.claim_support(a.join(b, ["conv_id", "turn"])).select("conv_id", "turn", "coverage", "anchored", "supported")


@query("""SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_suppkey) AS INTEGER) AS number, claims FROM
  (SELECT l_orderkey, l_suppkey, MIN(l_linenumber) AS first, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS claims FROM lineitem GROUP BY 1, 2)""")
def gnd05_citations(t):
    return grounding.citations(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey")


@query("""SELECT conv_id, string_agg(left(text, 100), ' ' ORDER BY turn) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') WHERE r <= 3 GROUP BY 1""")
def gnd06_extractive_answer(t):
    first = paging.latest(t.conversations.where("role = 'assistant'"), ["conv_id"], [F.asc("turn")], 3)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 100).alias("s"))))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("answer"))


@query("SELECT o_orderkey, CASE WHEN n IS NULL THEN 'No evidence.' WHEN n > 5 THEN 'Conflicting: [' || n || ']' ELSE 'Total [' || n || ']' END AS answer FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def gnd07_rendering(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    c = F.col("n").cast("string")
    return t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.when(F.col("n").isNull(), "No evidence.").when(F.col("n") > 5, F.concat(F.lit("Conflicting: ["), c, F.lit("]"))).otherwise(F.concat(F.lit("Total ["), c, F.lit("]"))).alias("answer"))


@query("""SELECT o_orderkey, ABS(s - o_totalprice) < 0.01 AS equal, CASE WHEN ABS(s - o_totalprice) < 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders JOIN (SELECT l_orderkey, SUM(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def gnd08_rederive(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    same = F.abs(F.col("s") - F.col("o_totalprice")) < 0.01
    return t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", same.alias("equal"), F.when(same, 1.0).otherwise(0.0).alias("score"))


@query("""SELECT conv_id, 'turn gap' AS violation FROM conversations GROUP BY 1 HAVING MAX(turn) - MIN(turn) + 1 <> COUNT(*) UNION ALL SELECT conv_id, 'no user' FROM conversations GROUP BY 1 HAVING COUNT(*) FILTER (WHERE role = 'user') = 0
  UNION ALL SELECT conv_id, 'long turn' FROM conversations WHERE length(text) > 400""")
def gnd09_violations(t):
    g = t.conversations.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count("*").alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("users"))
    named = lambda df, what: df.select("conv_id", F.lit(what).alias("violation"))
    return paging.union_all(named(g.where("span != n"), "turn gap"), named(g.where("users = 0"), "no user"), named(t.conversations.where("length(text) > 400"), "long turn"))


ENVELOPES = """e AS (SELECT doc_id, item_id, d.text AS content, CASE WHEN doc_id % 5 = 0 THEN sha256('old' || d.text) ELSE sha256(d.text) END AS h, b.text AS quote, strpos(d.text, b.text) - 1 + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS a,
    strpos(d.text, b.text) - 1 + length(b.text) + CASE WHEN doc_id % 5 = 2 THEN 1000000 ELSE 0 END AS b, CAST(5 AS INTEGER) AS x, CAST(CASE WHEN doc_id % 5 = 3 THEN 100000 ELSE 25 END AS INTEGER) AS y FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
  s AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'hash_mismatch' WHEN doc_id % 5 = 2 THEN 'span' WHEN substring(content, a + 1, b - a) <> quote THEN 'quote' WHEN y > b - a THEN 'sub_span' ELSE 'exact' END AS status FROM e)"""


@query(f"WITH {ENVELOPES} SELECT doc_id, item_id, status, CASE WHEN status = 'exact' THEN sha256(substring(content, a + x + 1, y - x)) END AS sub_sha256 FROM s")
def gnd10_envelope(t):
    """Passages in documents as stored evidence: some of another text, off by one, out of bounds, or asked for beyond their span."""
    hit = fulltext.contained(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("quote")), "doc_id")
    at, kind = F.position("quote", "text") - 1, F.col("doc_id") % 5
    rows = hit.select(
        "doc_id", "item_id", F.col("text").alias("content"), F.sha2(F.when(kind == 0, F.concat(F.lit("old"), "text")).otherwise(F.col("text")).cast("binary"), 256).alias("content_sha256"), "quote", F.sha2(F.col("quote").cast("binary"), 256).alias("quote_sha256"),
        (at + F.when(kind == 1, 1).otherwise(0)).alias("start"), (at + F.length("quote") + F.when(kind == 2, 1_000_000).otherwise(0)).alias("end"), F.lit(5).alias("sub_start"), F.when(kind == 3, 100_000).otherwise(25).alias("sub_end"),
    )
    return grounding.envelopes(rows).select("doc_id", "item_id", "status", "sub_sha256")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) = CAST(q AS BIGINT) AS equal FROM lineitem JOIN (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R') ON k = l_orderkey AND n = l_linenumber")
def gnd11_replay(t):
    frozen = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return t.lineitem.join(frozen, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") == F.col("q")).alias("equal"))


@query("""WITH truth AS (SELECT DISTINCT l_orderkey AS query, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), ranked AS (SELECT l_orderkey AS query, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY MAX(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
  w AS (SELECT query, COUNT(*) AS relevant FROM truth GROUP BY 1), h AS (SELECT query, COUNT(*) FILTER (WHERE rank <= 3) AS hit, MIN(rank) AS first, SUM(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE rank <= 3) AS dcg FROM ranked SEMI JOIN truth USING (query, item) GROUP BY 1)
  SELECT query, ROUND(hit / relevant, 6) AS recall, ROUND(hit / 3, 6) AS precision, ROUND(1.0::DOUBLE / first, 6) AS reciprocal_rank, ROUND(COALESCE(dcg, 0) / (1 + CASE WHEN relevant > 1 THEN 1 / log2(3) ELSE 0 END + CASE WHEN relevant > 2 THEN 1 / log2(4) ELSE 0 END), 6) AS ndcg, hit = relevant AS complete FROM w JOIN h USING (query)""")
def eval02_metrics(t):
    truth = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("item")).distinct()
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("item")).agg(F.max("l_extendedprice").alias("p"))
    ranked = best.select("query", "item", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("p"), "item")).alias("rank"))
    return evaluation.metrics(ranked, truth, 3)


@query("""SELECT k AS label, ROUND(AVG(toxic), 6) AS toxic, ROUND(AVG(quality), 6) AS quality, COUNT(*) AS n FROM (SELECT toxic, quality, unnest([lang, source, 'all']) AS k FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def eval_agg24_cohort_means(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select("toxic", "quality", F.explode(F.array("lang", "source", F.lit("all"))).alias("label"))
    return rows.groupBy("label").agg(F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"), F.count("*").alias("n"))


@query("""WITH v AS (SELECT 'good' AS metric, AVG(quality) AS value FROM labels UNION ALL SELECT 'toxic', AVG(toxic) FROM labels), r(metric, operator, bound) AS (VALUES ('good', '>=', 0.5::DOUBLE), ('toxic', '<=', 0.01::DOUBLE), ('absent', '==', 1.0::DOUBLE))
  SELECT metric, operator, bound, COALESCE(CASE operator WHEN '>=' THEN value >= bound WHEN '<=' THEN value <= bound ELSE value = bound END, FALSE) AS passed FROM r LEFT JOIN v USING (metric)""")
def eval03_gates(t):
    values = t.labels.agg(F.avg("quality").alias("good"), F.avg("toxic").alias("toxic")).unpivot([], ["good", "toxic"], "metric", "value")
    return evaluation.gates(values, t.spark.createDataFrame([("good", ">=", 0.5), ("toxic", "<=", 0.01), ("absent", "==", 1.0)], "metric string, operator string, bound double"))


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS y FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
  SELECT l_orderkey, ROUND(COALESCE(len(list_intersect(x, y)), 0) / len(x), 6) AS recall FROM a LEFT JOIN b USING (l_orderkey)""")
def eval04_ann_recall(t):
    exact = t.lineitem.select("l_orderkey", "l_partkey")
    return evaluation.top_list_recall(exact, t.lineitem.where("l_quantity > 10"), "l_orderkey", "l_partkey").select("l_orderkey", "recall")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IN ('purchase', 'error') AND p IS DISTINCT FROM event_type")
def str01_transitions(t):
    return lifecycle.transitions(t.events, "user_id", ["ts", "event_id"], "event_type", ["purchase", "error"]).select("event_id", "event_type")


@query("SELECT MIN(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)")
def str02_10_idempotency(t):
    return t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("d")).agg(F.min("event_id").alias("event_id")).drop("d")


@query("""SELECT event_id, array_to_string(list_sort(list(s_suppkey)), ',') AS recipients FROM events JOIN supplier ON s_nationkey = user_id % 25 AND ts >= TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 20 AS INTEGER)) GROUP BY 1""")
def str03_recipient_snapshot(t):
    since = F.to_timestamp_ntz(F.lit("2024-01-01")) + F.make_dt_interval((F.col("s_suppkey") % 20).cast("int"))
    members = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), since.alias("since"))
    events = t.events.select("event_id", (F.col("user_id") % 25).cast("int").alias("nation"), "ts")
    return lifecycle.recipient_snapshots(events, members, "event_id", "nation", "ts", "s_suppkey", "since")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def str04_preference_gate(t):
    off = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return t.events.join(off, "user_id", "left_anti").select("event_id")


@query("SELECT event_id, user_id, CASE WHEN p IS NULL THEN 'created' WHEN event_type = 'error' THEN 'deleted' WHEN p <> event_type THEN 'changed' ELSE 'same' END AS change FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def str05_change_events(t):
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select("event_id", "user_id", "event_type", p.alias("p"))
    return rows.select("event_id", "user_id", F.when(F.col("p").isNull(), "created").when(F.col("event_type") == "error", "deleted").when(F.col("p") != F.col("event_type"), "changed").otherwise("same").alias("change"))


@query("SELECT conv_id, CAST(i AS INTEGER) AS position, role FROM (SELECT conv_id, unnest(list(role ORDER BY turn)) AS role, unnest(range(1, COUNT(*) + 1)) AS i FROM conversations GROUP BY 1) WHERE i > 2")
def str06_array_growth(t):
    grown = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("e"))
    tail = grown.where(F.size("e") > 2).select("conv_id", F.posexplode(F.expr("slice(e, 3, size(e) - 2)")).alias("p", "x"))
    return tail.select("conv_id", (F.col("p") + 3).alias("position"), "x.role")


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND ts <= TIMESTAMP '2024-01-10') OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-02') ORDER BY ts, event_id LIMIT 100")
def str07_ready_rows(t):
    ready = ((F.col("event_type") == "click") & (F.col("ts") <= F.to_timestamp_ntz(F.lit("2024-01-10")))) | ((F.col("event_type") == "view") & (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-02"))))
    return t.events.where(ready).orderBy("ts", "event_id").limit(100).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'signup' AND ts < TIMESTAMP '2024-01-15' THEN 'timeout' ELSE event_type END AS status FROM events")
def str15_stale_runs(t):
    return t.events.select("event_id", F.when((F.col("event_type") == "signup") & (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-15"))), "timeout").otherwise(F.col("event_type")).alias("status"))


@query("SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'purchase') AS delivered, COUNT(*) FILTER (WHERE event_type = 'view') AS skipped, COUNT(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def str18_fanout_counters(t):
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return t.events.groupBy("user_id").agg(n("purchase").alias("delivered"), n("view").alias("skipped"), n("error").alias("failed"))

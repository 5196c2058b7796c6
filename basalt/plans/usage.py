"""Usage, dashboard, window, paging and set queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators import paging, usage
from basalt.operators.percentiles import exact_percentiles
from basalt.plans.registry import Tables, query

AS_OF, DAYS = "2024-01-30", 14
SINCE = "created_at >= TIMESTAMP '2024-01-17' AND created_at < TIMESTAMP '2024-01-31'"
RUNS = """runs AS (SELECT event_id AS run_id, user_id, NULLIF(event_type, 'view') AS model_used,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
  value AS latency, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS reserved_tokens, ts AS created_at FROM events)"""


def runs(t: Tables) -> DataFrame:
    """The event table read as a run log."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("completed")
    return t.events.select(F.col("event_id").alias("run_id"), "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("model_used"), status.alias("status"), F.col("value").alias("latency"), tokens.alias("total_tokens"), (tokens * 2).alias("reserved_tokens"), F.col("ts").alias("created_at"))




@query(f"""WITH {RUNS} SELECT COUNT(*) AS queries, CAST(COALESCE(SUM(total_tokens), 0) AS BIGINT) AS tokens,
  ROUND(AVG(latency) FILTER (WHERE status = 'completed'), 6) AS avg_latency, COUNT(*) FILTER (WHERE status <> 'completed') AS failed FROM runs WHERE {SINCE}""")
def agg01_usage_overview(t):
    return usage.overview(usage.since(runs(t), "created_at", AS_OF, DAYS), F.col("status") == "completed")


@query(f"""WITH {RUNS} SELECT ROUND(quantile_cont(latency, 0.5) FILTER (WHERE status = 'completed'), 6) AS p50,
  ROUND(quantile_cont(latency, 0.95) FILTER (WHERE status = 'completed'), 6) AS p95, ROUND(quantile_cont(latency, 0.99) FILTER (WHERE status = 'completed'), 6) AS p99 FROM runs""")
def agg02_latency_percentiles(t):
    return usage.percentiles(runs(t), "latency", F.col("status") == "completed", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"WITH {RUNS} SELECT COALESCE(model_used, 'unknown') AS model, COUNT(*) AS queries, CAST(SUM(total_tokens) AS BIGINT) AS tokens FROM runs GROUP BY 1")
def agg03_model_usage(t):
    return runs(t).groupBy(F.coalesce("model_used", F.lit("unknown")).alias("model")).agg(F.count("*").alias("queries"), F.sum("total_tokens").alias("tokens"))


@query(f"""WITH {RUNS}, d AS (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS queries, CAST(SUM(total_tokens) AS BIGINT) AS tokens FROM runs GROUP BY 1)
  SELECT CAST(c.day AS DATE) AS day, COALESCE(d.queries, 0) AS queries, COALESCE(d.tokens, 0) AS tokens
  FROM (SELECT unnest(generate_series(DATE '2024-02-05' - 29, DATE '2024-02-05', INTERVAL 1 DAY)) AS day) c LEFT JOIN d ON d.day = CAST(c.day AS DATE)""")
def agg04_daily_series(t):
    return usage.daily_series(runs(t), "2024-02-05", 30)


@query(f"""WITH {RUNS}, c AS (SELECT COUNT(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-30') AS today, COUNT(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-29') AS yesterday FROM runs)
  SELECT today, yesterday, CASE WHEN yesterday > 0 THEN ROUND((today - yesterday) * 100.0::DOUBLE / yesterday, 1) END AS change_percent FROM c""")
def agg05_today_vs_yesterday(t):
    day = F.to_date("created_at")
    c = runs(t).agg(F.count(F.when(day == F.lit("2024-01-30"), 1)).alias("today"), F.count(F.when(day == F.lit("2024-01-29"), 1)).alias("yesterday"))
    return c.withColumn("change_percent", usage.change_percent(F.col("today"), F.col("yesterday")))


@query(f"""WITH {RUNS} SELECT user_id, CAST(SUM(CASE WHEN status = 'running' THEN 0 ELSE total_tokens END) AS BIGINT) AS used,
  CAST(SUM(CASE WHEN status = 'running' THEN GREATEST(total_tokens, reserved_tokens) ELSE 0 END) AS BIGINT) AS reserved,
  CAST(GREATEST(0, 100000 - SUM(CASE WHEN status = 'running' THEN GREATEST(total_tokens, reserved_tokens) ELSE total_tokens END)) AS BIGINT) AS remaining FROM runs GROUP BY 1""")
def agg06_token_budget(t):
    return usage.token_budget(runs(t), "user_id", 100_000)


@query("SELECT c_custkey, CAST(LEAST(a, 10000, GREATEST(1000, a // 10)) AS BIGINT) AS reservation FROM (SELECT c_custkey, CAST(ABS(c_acctbal) * 20 AS BIGINT) AS a FROM customer)")
def agg07_reservation(t):
    return t.customer.select("c_custkey", F.round(F.abs("c_acctbal") * 20).cast("long").alias("a")).select("c_custkey", usage.reservation(F.col("a")).cast("long").alias("reservation"))


@query("""SELECT source, COUNT(*) FILTER (WHERE n_chars > 500) AS live, COUNT(*) FILTER (WHERE lang = 'en') AS ready, CAST(SUM(strlen(text)) AS BIGINT) AS bytes,
  CAST(SUM(n_chars) FILTER (WHERE lang = 'en') AS BIGINT) AS ready_chars FROM documents GROUP BY 1""")
def agg08_document_stats(t):
    english = F.col("lang") == "en"
    return t.documents.groupBy("source").agg(F.count(F.when(F.col("n_chars") > 500, 1)).alias("live"), F.count(F.when(english, 1)).alias("ready"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(F.when(english, F.col("n_chars"))).alias("ready_chars"))


@query("""SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open, COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-26' AND o_orderdate < TIMESTAMP '2001-08-02') AS last_week,
  COUNT(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS done_value FROM orders""")
def agg09_dashboard_metrics(t):
    week = (F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-07-26"))) & (F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("2001-08-02")))
    return t.orders.agg(F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"), F.count(F.when(week, 1)).alias("last_week"), F.count(F.when(F.col("o_orderpriority").startswith("1"), 1)).alias("urgent"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("done_value"))


@query("SELECT o_orderpriority AS priority, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def agg10_status_counts(t):
    one = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(one("O").alias("open"), one("F").alias("done"), one("P").alias("pending"))


@query("SELECT DISTINCT p_brand AS facet FROM part ORDER BY 1 LIMIT 100")
def agg11_facets(t):
    return t.part.select(F.col("p_brand").alias("facet")).distinct().orderBy("facet").limit(100)


@query("SELECT l_orderkey, BOOL_OR(l_returnflag = 'R') AS any_returned, BOOL_AND(l_linestatus = 'F') AS complete, COUNT(*) AS lines FROM lineitem GROUP BY 1")
def agg12_completion(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("complete"), F.count("*").alias("lines"))


@query("SELECT source, CASE WHEN COUNT(DISTINCT lang) = 1 THEN MIN(lang) ELSE 'mixed' END AS profile FROM documents GROUP BY 1")
def agg13_profile_consensus(t):
    return t.documents.groupBy("source").agg(F.when(F.countDistinct("lang") == 1, F.min("lang")).otherwise("mixed").alias("profile"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS order_ids FROM orders GROUP BY 1")
def agg14_ordered_ids(t):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderkey"].cast("string")), ",").alias("order_ids"))


@query("""SELECT event_type, LEAST(COUNT(*), 500) AS depth, COUNT(*) > 500 AS over_cap, MAX(date_sub('second', ts, TIMESTAMP '2024-02-01')) AS max_age
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 501 GROUP BY 1""")
def agg15_queue_depth(t):
    age = F.expr("timestampdiff(SECOND, ts, TIMESTAMP_NTZ '2024-02-01 00:00:00')")
    return usage.queue_depths(t.events, "event_type", ["ts", "event_id"], age, 500)


@query("""SELECT r_name, CAST(json_object('region', r_name, 'nations', n, 'first', f) AS VARCHAR) AS document FROM (SELECT r_name, COUNT(*) AS n, MIN(n_name) AS f FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""")
def agg16_json_document(t):
    g = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"), F.min("n_name").alias("first"))
    return g.select("r_name", F.to_json(F.struct(F.col("r_name").alias("region"), "nations", "first")).alias("document"))


@query("SELECT o_custkey, CAST(COALESCE(MAX(l_linenumber), 0) + 1 AS INTEGER) AS next_version FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def agg17_next_version(t):
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    return t.orders.join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg((F.coalesce(F.max("m"), F.lit(0)) + 1).alias("next_version"))


@query("SELECT COUNT(*) AS records, CAST(SUM(strlen(json_object('k', n_nationkey, 'name', n_name))) AS BIGINT) AS bytes FROM nation")
def agg18_export_admission(t):
    return t.nation.agg(F.count("*").alias("records"), F.sum(F.octet_length(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))).cast("long")).alias("bytes"))


@query("""SELECT label, COUNT(*) AS members, COUNT(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, COUNT(*) FILTER (WHERE n = 0) AS zero, COUNT(*) FILTER (WHERE ABS(n - 1) > 0.001) AS off_norm
  FROM (SELECT *, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS n FROM embeddings) GROUP BY 1""")
def agg20_generation_gate(t):
    from basalt.operators.retrieval import norm

    e = t.embeddings.withColumn("n", norm(F.col("embedding")))
    return e.groupBy("label").agg(F.count("*").alias("members"), F.count(F.when(F.size("embedding") != 64, 1)).alias("wrong_size"), F.count(F.when(F.col("n") == 0, 1)).alias("zero"), F.count(F.when(F.abs(F.col("n") - 1) > 0.001, 1)).alias("off_norm"))


@query("""SELECT source, COUNT(*) AS eligible, CASE WHEN source = 'src0' THEN NULL ELSE 60 END AS capacity, CASE WHEN source = 'src0' THEN TRUE ELSE COUNT(*) <= 60 END AS fits FROM documents WHERE n_chars > 0 GROUP BY 1""")
def agg21_generation_capacity(t):
    unlimited = F.col("source") == "src0"
    g = t.documents.where("n_chars > 0").groupBy("source").agg(F.count("*").alias("eligible"))
    return g.select("source", "eligible", F.when(~unlimited, F.lit(60)).alias("capacity"), (unlimited | (F.col("eligible") <= 60)).alias("fits"))


@query("""WITH c AS (SELECT o_custkey AS k, COUNT(*) AS documents, ROUND(SUM(o_totalprice), 2) AS used FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), r AS (SELECT o_custkey AS k, COUNT(*) AS pending, ROUND(SUM(o_totalprice), 2) AS reserved FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
  SELECT c_custkey, COALESCE(documents, 0) AS documents, COALESCE(used, 0.0::DOUBLE) AS used, COALESCE(pending, 0) AS pending, COALESCE(reserved, 0.0::DOUBLE) AS reserved FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN r ON r.k = c_custkey""")
def agg22_join08_storage_usage(t):
    """Usage and reservations of every owner, zeros for those without any: two aggregates joined to the owners."""
    kept, open_ = F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "P"
    sums = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.when(kept, 1)).alias("documents"), F.round(F.sum(F.when(kept, F.col("o_totalprice"))), 2).alias("used"), F.count(F.when(open_, 1)).alias("pending"), F.round(F.sum(F.when(open_, F.col("o_totalprice"))), 2).alias("reserved")
    )
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return t.customer.join(sums, "c_custkey", "left").select("c_custkey", zero("documents", 0), zero("used", 0.0), zero("pending", 0), zero("reserved", 0.0))


@query("SELECT ROUND(quantile_cont(o_totalprice, 0.25), 6) AS q1, ROUND(quantile_cont(o_totalprice, 0.75), 6) AS q3, o_orderstatus FROM orders GROUP BY o_orderstatus")
def agg25_interpolated_percentile(t):
    found = exact_percentiles(t.orders, ["o_orderstatus"], "o_totalprice", {"q1": 0.25, "q3": 0.75})
    return found.select("o_orderstatus", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


@query("SELECT 'documents' AS collection, COUNT(*) AS records FROM documents UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'region', COUNT(*) FROM region UNION ALL SELECT 'settings', CAST(COUNT(*) > 0 AS BIGINT) FROM nation")
def agg26_record_counts(t):
    count = lambda name, df: df.agg(F.lit(name).alias("collection"), F.count("*").alias("records"))
    return paging.union_all(count("documents", t.documents), count("orders", t.orders), count("region", t.region), t.nation.agg(F.lit("settings").alias("collection"), (F.count("*") > 0).cast("long").alias("records")))


@query("SELECT conv_id, COUNT(*) FILTER (WHERE role = 'user') AS user_turns, COUNT(*) FILTER (WHERE role = 'assistant') AS assistant_turns FROM conversations GROUP BY 1")
def agg27_kind_counts(t):
    g = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    kinds = lambda k: F.size(F.filter("roles", lambda r: r == k)).cast("long")
    return g.select("conv_id", kinds("user").alias("user_turns"), kinds("assistant").alias("assistant_turns"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) r FROM lineitem) WHERE r = 1")
def win01_best_line(t):
    return paging.latest(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P') AS total_matches FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 25")
def win02_total_matches(t):
    # The total is an aggregate of its own: a window over all rows would need one task.
    hits = t.orders.where("o_orderstatus = 'P'")
    return hits.orderBy("o_orderkey").limit(25).select("o_orderkey").crossJoin(F.broadcast(hits.agg(F.count("*").alias("total_matches"))))


@query("SELECT conv_id, role, MAX(turn) AS turn FROM conversations GROUP BY 1, 2")
def win03_keep_latest(t):
    return paging.latest(t.conversations, ["conv_id", "role"], [F.desc("turn")]).select("conv_id", "role", "turn")


@query("""SELECT doc_id, keep AS superseded_by FROM (SELECT doc_id, first_value(doc_id) OVER w AS keep, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY lower(text) ORDER BY doc_id DESC)) WHERE r > 1""")
def win04_supersede_duplicates(t):
    w = Window.partitionBy("h").orderBy(F.desc("doc_id"))
    rows = t.documents.select("doc_id", F.sha2(F.lower("text").cast("binary"), 256).alias("h"))
    return rows.withColumn("superseded_by", F.first("doc_id").over(w)).withColumn("r", F.row_number().over(w)).where("r > 1").select("doc_id", "superseded_by")


@query("""SELECT event_type, event_id, CASE WHEN date_sub('second', ts, TIMESTAMP '2024-01-31') <= 3600 THEN 'healthy' ELSE 'stale' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1""")
def win05_latest_heartbeat(t):
    age = F.expr("timestampdiff(SECOND, ts, TIMESTAMP_NTZ '2024-01-31 00:00:00')")
    return paging.latest(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", F.when(age <= 3600, "healthy").otherwise("stale").alias("status"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) r FROM conversations) WHERE r <= 4")
def win07_last_turns(t):
    last = paging.latest(t.conversations, ["conv_id"], [F.desc("turn")], 4)
    return last.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("position"))


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) AS INTEGER) AS rank FROM (SELECT user_id, event_type, ROUND(SUM(value), 4) AS v FROM events GROUP BY 1, 2)")
def win08_rank_positions(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return g.select("user_id", "event_type", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("v"), "user_id")).alias("rank"))


@query("""SELECT o_orderkey, o_orderdate, TRUE AS has_more FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 100) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def top01_prj04_keyset_page(t):
    import datetime

    return paging.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), [("o_orderdate", True), ("o_orderkey", True)], 20, [datetime.datetime(1998, 1, 1), 100]).select("o_orderkey", "o_orderdate", "has_more")


@query("""SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size < 25 OR (p_size = 25 AND (p_retailprice < 1000 OR (p_retailprice = 1000 AND p_partkey > 10))) ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 15""")
def top02_three_key_page(t):
    return paging.keyset_page(t.part.select("p_partkey", "p_size", "p_retailprice"), [("p_size", True), ("p_retailprice", True), ("p_partkey", False)], 15, [25, 1000.0, 10]).drop("has_more")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 40")
def top03_offset_page(t):
    return t.customer.select("c_custkey", "c_name").orderBy("c_custkey").offset(40).limit(10)


ACTIVITY = """SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS created_at, LEFT(o_orderpriority, 140) AS title FROM orders
  UNION ALL SELECT 'event', event_id, ts, event_type FROM events UNION ALL SELECT 'shipment', l_orderkey * 10 + l_linenumber, l_shipdate, l_returnflag FROM lineitem"""


@query(f"SELECT * FROM ({ACTIVITY}) ORDER BY created_at DESC, kind, id LIMIT 10")
def top06_set01_activity_feed(t):
    order = [F.desc("created_at"), F.asc("kind"), F.asc("id")]
    feeds = [
        t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.substring("o_orderpriority", 1, 140).alias("title")),
        t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("title")),
        t.lineitem.select(F.lit("shipment").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("title")),
    ]
    # Each feed's own ten first: the union then sorts thirty rows.
    return paging.top(paging.union_all(*[f.orderBy(*order).limit(10) for f in feeds]), order, 10)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def top08_fair_pick(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, 'processing' AS status FROM events WHERE event_type IN ('click', 'purchase') ORDER BY ts, event_id LIMIT 50")
def top09_claim_batch(t):
    return t.events.where(F.col("event_type").isin("click", "purchase")).orderBy("ts", "event_id").limit(50).select("event_id", F.lit("processing").alias("status"))


@query("""(SELECT 'oldest' AS kind, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5) UNION ALL (SELECT 'dearest', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)""")
def set02_union_of_limits(t):
    pick = lambda kind, *order: t.orders.orderBy(*order).limit(5).select(F.lit(kind).alias("kind"), "o_orderkey")
    return pick("oldest", "o_orderdate", "o_orderkey").unionByName(pick("dearest", F.desc("o_totalprice"), "o_orderkey"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set03_scope_union(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("""(SELECT c_nationkey AS nation, 'customers' AS only_in FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier) UNION ALL (SELECT s_nationkey, 'suppliers' FROM supplier EXCEPT SELECT c_nationkey, 'suppliers' FROM customer)""")
def set04_symmetric_difference(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation"))
    return a.subtract(b).withColumn("only_in", F.lit("customers")).unionByName(b.subtract(a).withColumn("only_in", F.lit("suppliers")))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, epoch_us(MAX(ts)) // 1000000 AS last_second, COUNT(*) AS n FROM events GROUP BY 1")
def fn24_day_and_epoch(t):
    return t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.max("ts").alias("m"), F.count("*").alias("n")).select("day", F.unix_timestamp(F.col("m").cast("timestamp")).alias("last_second"), "n")


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus = 'F' THEN 100 ELSE LEAST(99, FLOOR(l_quantity * 100 / 50)) END AS INTEGER) AS progress FROM lineitem")
def fn26_progress(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", 100).otherwise(F.least(F.lit(99), F.floor(F.col("l_quantity") * 100 / 50))).cast("int").alias("progress"))


@query("SELECT event_id, CAST(LEAST(300, POW(2, LEAST(CAST(user_id AS INTEGER) % 12, 8))) AS INTEGER) AS backoff FROM events")
def fn27_str08_backoff(t):
    return t.events.select("event_id", F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(F.col("user_id") % 12, F.lit(8)))).cast("int").alias("backoff"))


@query("""WITH rates(p_brand_last, input_rate, tier_rate) AS (VALUES ('1', 2.5, 5.0), ('2', 0.5, 1.0), ('3', 10.0, 20.0))
  SELECT p_partkey, ROUND(CAST(p_size AS DOUBLE) * 10000 / 1000000 * CASE WHEN p_size * 10000 >= 272000 THEN tier_rate ELSE input_rate END, 8) AS cost FROM part LEFT JOIN rates ON p_brand_last = RIGHT(p_brand, 1)""")
def fn28_cost_estimate(t):
    rates = t.spark.createDataFrame([("1", 2.5, 5.0), ("2", 0.5, 1.0), ("3", 10.0, 20.0)], "brand string, input_rate double, tier_rate double")
    tokens = F.col("p_size") * 10_000
    cost = tokens.cast("double") / 1_000_000 * F.when(tokens >= 272_000, F.col("tier_rate")).otherwise(F.col("input_rate"))
    return t.part.join(F.broadcast(rates), F.substring("p_brand", -1, 1) == F.col("brand"), "left").select("p_partkey", F.round(cost, 8).alias("cost"))


@query("SELECT p_partkey, CAST(b AS INTEGER) AS batch, CAST(b * 20 AS INTEGER) AS first, CAST(LEAST(b * 20 + 20, p_size) AS INTEGER) AS last FROM (SELECT p_partkey, p_size, unnest(range(0, (p_size + 19) // 20)) AS b FROM part WHERE p_size > 0)")
def fn37_batch_ranges(t):
    batches = t.part.where("p_size > 0").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.floor((F.col("p_size") - 1) / 20).cast("int"))).alias("batch"))
    return batches.select("p_partkey", "batch", (F.col("batch") * 20).alias("first"), F.least(F.col("batch") * 20 + 20, "p_size").alias("last"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def flt16_json_predicate(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k")).where("k > 50")


@query("""SELECT CAST(time_bucket(INTERVAL '60 seconds', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS requests, COUNT(*) > 1 AS limited FROM events GROUP BY 1, 2""")
def str12_rate_limit(t):
    g = t.events.groupBy(F.window("ts", "60 seconds").alias("w"), "event_type").agg(F.count("*").alias("requests"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "requests", (F.col("requests") > 1).alias("limited"))

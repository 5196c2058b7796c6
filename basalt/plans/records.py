"""Record changes, requests, uploads, export plans and outbox queries. Events are requests, notifications and outbox rows; orders are uploads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import text as X
from basalt.operators import grounding
from basalt.operators import records as R
from basalt.plans.registry import query
from basalt.sources import archive
from basalt.tables import fresh_path

NOW = "TIMESTAMP '2024-01-20'"


def now():
    return F.to_timestamp_ntz(F.lit("2024-01-20"))


def span(**kw):
    return F.make_dt_interval(*[F.lit(kw.get(k, 0)) for k in ("days", "hours", "minutes")])


@query("SELECT event_id FROM events WHERE event_id IN (3, 14, 15, 92, 65, 358) AND user_id < 120")
def dml02_bulk_ids(t):
    return R.bulk_change(t.events, "event_id", [3, 14, 15, 92, 65, 358], F.col("user_id") < 120)


REQUESTS = "r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type AS body, CASE WHEN value < 60 THEN 'completed' ELSE 'running' END AS state, 'r' || event_id AS response FROM events)"


@query(f"""WITH {REQUESTS}, f AS (SELECT user_id, day, MIN(event_id) AS first FROM r GROUP BY 1, 2), j AS (SELECT r.*, f.first, x.body AS b, x.state AS s, x.response AS p FROM r JOIN f USING (user_id, day) JOIN r x ON x.event_id = f.first)
  SELECT event_id, CASE WHEN event_id = first THEN 'accepted' WHEN body <> b THEN 'conflict' WHEN s = 'completed' THEN 'replayed' ELSE 'in_progress' END AS outcome, CASE WHEN event_id <> first AND body = b AND s = 'completed' THEN p END AS stored FROM j""")
def dml06_ing10_request_fingerprint(t):
    r = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("body"), F.when(F.col("value") < 60, "completed").otherwise("running").alias("state"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response"))
    return R.idempotent(r, ["user_id", "day"], ["event_id"], F.col("body"), "state", "response").select("event_id", "outcome", "stored")


@query(r"""WITH a AS (SELECT conv_id % 7 AS who, text AS fact FROM conversations WHERE role = 'system'), n AS (SELECT conv_id % 7 AS who, conv_id * 1000 + turn AS place, CASE WHEN turn % 3 = 0 THEN lower(left(text, 12)) ELSE left(text, 12) END || CASE WHEN turn % 5 = 0 THEN ' 123-45-6789' ELSE '' END AS fact, turn % 2 = 0 AS confirmed FROM conversations WHERE role <> 'system'),
  h AS (SELECT who, COUNT(*) AS had FROM a GROUP BY 1), f AS (SELECT n.*, lower(n.fact) AS k, COALESCE(had, 0) AS had, regexp_matches(fact, '\b\d{3}-\d{2}-\d{4}\b') AND NOT confirmed AS ask, EXISTS (SELECT 1 FROM a WHERE a.who = n.who AND lower(a.fact) = lower(n.fact)) AS known FROM n LEFT JOIN h USING (who)),
  o AS (SELECT *, CASE WHEN NOT ask AND NOT known THEN row_number() OVER (PARTITION BY who, k, NOT ask AND NOT known ORDER BY place) END AS nth FROM f), c AS (SELECT *, had + SUM(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY place ROWS UNBOUNDED PRECEDING) AS number FROM o)
  SELECT place, CASE WHEN ask THEN 'confirm' WHEN known OR nth > 1 THEN 'duplicate' WHEN number > 40 THEN 'full' ELSE 'inserted' END AS outcome FROM c""")
def dml05_capped_insert(t):
    c = t.conversations
    who = (F.col("conv_id") % 7).alias("who")
    start = F.substring("text", 1, 12)
    fact = F.concat(F.when(F.col("turn") % 3 == 0, F.lower(start)).otherwise(start), F.when(F.col("turn") % 5 == 0, " 123-45-6789").otherwise(""))
    new = c.where("role != 'system'").select(who, (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), fact.alias("fact"), (F.col("turn") % 2 == 0).alias("confirmed"))
    active = c.where("role = 'system'").select(who, F.col("text").alias("fact"))
    return R.insert_facts(active, new, "who", "fact", "confirmed", F.size(X.sensitive(F.col("fact"))) > 0, 40).select("place", "outcome")


INTENTS = "i AS (SELECT event_id AS id, user_id AS tenant, CAST(FLOOR(value) AS BIGINT) AS size, CASE event_type WHEN 'purchase' THEN 'stored' WHEN 'click' THEN 'uploading' WHEN 'view' THEN 'pending' ELSE 'abandoned' END AS status, CAST(user_id % 7 AS INTEGER) AS attempts, ts AS touched FROM events)"


def _intents(t):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "stored").when(kind == "click", "uploading").when(kind == "view", "pending").otherwise("abandoned")
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("tenant"), F.floor("value").alias("size"), status.alias("status"), (F.col("user_id") % 7).cast("int").alias("attempts"), F.col("ts").alias("touched"))


@query(f"WITH {INTENTS} SELECT tenant, COUNT(*) AS abandoned, CAST(SUM(size) AS BIGINT) AS released FROM i WHERE status IN ('pending', 'uploading') AND attempts >= 5 GROUP BY 1")
def ing27_abandon_uploads(t):
    return R.recover_uploads(_intents(t), now(), span(minutes=1), span(hours=2), 5)[0]


@query(f"WITH {INTENTS} SELECT id, attempts + 1 AS attempts FROM i WHERE attempts < 5 AND ((status = 'pending' AND touched <= {NOW} - INTERVAL 1 MINUTE) OR (status = 'uploading' AND touched <= {NOW} - INTERVAL 2 HOUR)) ORDER BY touched, id LIMIT 1")
def ing27_lease_upload(t):
    return R.recover_uploads(_intents(t), now(), span(minutes=1), span(hours=2), 5)[1]


@query("""WITH o AS (SELECT l_orderkey AS version, CASE WHEN COUNT(*) % 4 = 0 THEN 'deleted' WHEN COUNT(*) % 4 = 1 THEN 'unavailable' ELSE 'available' END AS status, COUNT(*) * 1000 AS bytes FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
  f AS (SELECT o_orderkey AS version, COALESCE(status = 'available', FALSE) AS included, CASE WHEN status IS NULL THEN 'missing' WHEN status <> 'available' THEN status END AS reason, bytes FROM orders LEFT JOIN o ON version = o_orderkey)
  SELECT version, included, reason, COUNT(*) FILTER (WHERE included) OVER () AS included_count, CAST(COALESCE(SUM(bytes) FILTER (WHERE included) OVER (), 0) AS BIGINT) AS total_bytes, COUNT(*) FILTER (WHERE included) OVER () = COUNT(*) OVER () AS complete,
  COUNT(*) FILTER (WHERE included) OVER () <= 256 AND COALESCE(SUM(bytes) FILTER (WHERE included) OVER (), 0) <= 33554432 AS within_limits FROM f""")
def snk06_capped_export(t):
    n = F.count("*")
    objects = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("version")).agg(F.when(n % 4 == 0, "deleted").when(n % 4 == 1, "unavailable").otherwise("available").alias("status"), (n * 1000).alias("bytes"))
    return R.export_plan(t.orders.select(F.col("o_orderkey").alias("version")), objects, 256, 33_554_432)


@query("""SELECT 'nations' AS entry, md5('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS line FROM nation UNION ALL SELECT 'parts', md5('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}') FROM part
  UNION ALL SELECT 'originals', md5('{"included":' || (item_id % 3 = 0) || ',"name":"i' || item_id || '","reason":' || CASE item_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"digest"' ELSE '"size"' END || ',"sha256":"' || sha256(CASE WHEN item_id % 3 = 1 THEN 'x' ELSE '' END || text) || '","size":' || (strlen(text) + CASE WHEN item_id % 3 = 2 THEN 1 ELSE 0 END) || '}') FROM benchmark
  UNION ALL SELECT 'originals/i' || item_id, md5(replace(base64(encode(text)), chr(10), '')) FROM benchmark WHERE item_id % 3 = 0""")
def snk03_archive(t):
    """An archive written by a two-phase commit and read back: rows of tables, and originals whose size and digest are as stored."""
    path = fresh_path(t.spark, "archive")
    body = F.col("text").cast("binary")
    k = F.col("item_id") % 3
    originals = t.benchmark.select(
        F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("name"), body.alias("content"), F.sha2(F.when(k == 1, F.concat(F.lit("x"), "text")).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"),
        (F.octet_length(body) + F.when(k == 2, 1).otherwise(0)).cast("long").alias("size"),
    )
    parts = t.part.select("p_partkey", "p_name")
    archive.export_archive({"nations": t.nation, "parts": parts}, path, originals, records=10**9, record_bytes=1 << 40)
    return archive.read_archive(t.spark, path)[0].select("entry", F.md5(F.col("line").cast("binary")).alias("line"))


@query("""WITH j AS (SELECT 'customers' AS entry, to_json({'balance': CAST(FLOOR(c_acctbal) AS BIGINT), 'key': c_custkey, 'name': c_name}) AS record FROM customer UNION ALL SELECT 'orders', to_json({'customer': o_custkey, 'key': o_orderkey, 'status': o_orderstatus}) FROM orders)
  SELECT entry, COUNT(*) AS records, CAST(SUM(strlen(record) + 1) AS BIGINT) AS bytes, COUNT(*) <= 250000 AND SUM(strlen(record) + 1) <= 67108864 AS within_limits FROM j GROUP BY 1""")
def snk03_export_entries(t):
    people = t.customer.select(F.lit("customers").alias("entry"), F.to_json(F.struct(F.floor("c_acctbal").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))).alias("record"))
    orders = t.orders.select(F.lit("orders").alias("entry"), F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("record"))
    size = F.sum(F.octet_length("record").cast("long") + 1)
    return people.unionByName(orders).groupBy("entry").agg(F.count("*").alias("records"), size.alias("bytes"), ((F.count("*") <= 250_000) & (size <= 67_108_864)).alias("within_limits"))


@query("""WITH e AS (SELECT l_orderkey AS document, l_partkey AS entity, COUNT(*) AS frequency, CAST(l_orderkey % 4 AS BIGINT) AS revision FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 4),
  s AS (SELECT l_orderkey AS document, l_partkey AS entity, COUNT(*) AS frequency, CAST(l_orderkey % 3 AS BIGINT) AS revision FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2, 4),
  h AS (SELECT document, MAX(revision) AS had FROM e GROUP BY 1), n AS (SELECT s.* FROM s LEFT JOIN h USING (document) WHERE had IS NULL OR revision > had)
  SELECT * FROM e WHERE document NOT IN (SELECT document FROM n) UNION ALL SELECT * FROM n""")
def snk05_replace_edges(t):
    def made(rows, revisions):
        k = F.col("l_orderkey")
        return rows.groupBy(k.alias("document"), F.col("l_partkey").alias("entity"), (k % revisions).cast("long").alias("revision")).agg(F.count("*").alias("frequency"))

    return R.replace_edges(made(t.lineitem.where("l_returnflag = 'A'"), 4), made(t.lineitem.where("l_orderkey % 2 = 0"), 3))


OUTBOX = """o AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'publishing' WHEN 'purchase' THEN 'published' WHEN 'signup' THEN 'processed' ELSE 'dead' END AS status, ts AS available, ts + INTERVAL 1 HOUR AS locked_at, ts + INTERVAL 2 HOUR AS published_at, CAST(user_id % 9 AS INTEGER) AS attempts, value FROM events)"""


def _outbox(t):
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "publishing").when(kind == "purchase", "published").when(kind == "signup", "processed").otherwise("dead")
    return t.events.select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("available"), (F.col("ts") + span(hours=1)).alias("locked_at"), (F.col("ts") + span(hours=2)).alias("published_at"), (F.col("user_id") % 9).cast("int").alias("attempts"), "value")


@query(f"""WITH {OUTBOX} SELECT id, status FROM o WHERE (status = 'pending' AND available <= {NOW}) OR (status = 'publishing' AND locked_at < {NOW} - INTERVAL 5 MINUTE) OR (status = 'published' AND published_at < {NOW} - INTERVAL 10 MINUTE) ORDER BY available, id LIMIT 100""")
def str07_09_claim_ready(t):
    return R.ready(_outbox(t), now(), span(minutes=5), span(minutes=10), 100).select("id", "status")


@query(f"""WITH {OUTBOX}, s AS (SELECT id, attempts + 1 AS attempts, available, CASE WHEN value > 20 THEN 'processed' WHEN attempts + 1 >= 8 THEN 'dead' ELSE 'pending' END AS status FROM o WHERE status = 'publishing')
  SELECT id, status, attempts, CASE WHEN status = 'pending' THEN {NOW} + to_seconds(LEAST(300, pow(2, LEAST(attempts, 8)))) ELSE available END AS available FROM s""")
def str08_settle(t):
    return R.settle(_outbox(t).where("status = 'publishing'"), now(), F.col("value") > 20, 8)


@query(f"WITH {OUTBOX} SELECT id FROM o WHERE status IN ('processed', 'dead') AND available < {NOW} - INTERVAL 7 DAY ORDER BY available, id LIMIT 500")
def str11_prune_outbox(t):
    return R.prune_outbox(_outbox(t), now(), span(days=7), 500)


@query("""WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT *, lag(n) OVER (PARTITION BY user_id, event_type ORDER BY n) AS p FROM n) SELECT event_id FROM b WHERE p IS NULL OR n - p > 4""")
def str14_broker_dedup(t):
    return R.first_deliveries(t.events, "user_id", ["ts", "event_id"], "event_type", 4).select("event_id")


@query("SELECT conv_id, CAST(turn AS BIGINT) AS version, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position, role AS element FROM conversations")
def str06_snapshot_growth(t):
    grown = F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return R.growth(t.conversations.select("conv_id", F.col("turn").alias("version"), grown.alias("roles")), "conv_id", "version", "roles")


@query("""WITH l AS (SELECT event_id, user_id AS id, ts, event_type = 'click' AS read, event_type = 'error' AND value > 95 AS deleted FROM events), w AS (SELECT *, row_number() OVER v AS n, lag(read) OVER v AS was, COALESCE(bool_or(deleted) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS gone FROM l WINDOW v AS (PARTITION BY id ORDER BY ts, event_id))
  SELECT event_id, change FROM (SELECT *, CASE WHEN n = 1 THEN 'created' WHEN deleted THEN 'deleted' WHEN was <> read THEN 'read_state_changed' END AS change FROM w WHERE NOT gone) WHERE change IS NOT NULL""")
def str05_notification_changes(t):
    log = t.events.select("event_id", F.col("user_id").alias("id"), "ts", (F.col("event_type") == "click").alias("read"), ((F.col("event_type") == "error") & (F.col("value") > 95)).alias("deleted"))
    return R.changes(log, "id", ["ts", "event_id"], "read", "deleted").select("event_id", "change")


PACK = """p0 AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'document' WHEN 'assistant' THEN 'memory' ELSE 'tool' END AS kind, CASE WHEN turn = 3 THEN '' ELSE text END AS content, turn % 2 = 1 AS failed FROM conversations),
  p1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS n FROM p0 WHERE NOT (failed AND kind = 'tool')),
  pack AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE kind WHEN 'document' THEN 1 WHEN 'memory' THEN 2 ELSE 4 END, turn) AS INTEGER) AS ordinal, CASE kind WHEN 'document' THEN 'D' WHEN 'memory' THEN 'M' ELSE 'T' END || n AS source_id, kind, content, sha256(content) AS content_sha256 FROM p1 WHERE content <> '')"""


def _pack(t):
    kind = F.when(F.col("role") == "user", "document").when(F.col("role") == "assistant", "memory").otherwise("tool")
    rows = t.conversations.select("conv_id", "turn", kind.alias("kind"), F.when(F.col("turn") == 3, "").otherwise(F.col("text")).alias("content"))
    return grounding.evidence_pack(rows, "conv_id", "turn", "kind", "content", F.col("turn") % 2 == 1)


@query(f"WITH {PACK} SELECT conv_id, ordinal, source_id, kind, content_sha256 FROM pack")
def gnd01_evidence_pack(t):
    return _pack(t).drop("content")


FAULTY = f"""{PACK}, located AS (SELECT conv_id, ordinal, CASE WHEN conv_id % 7 = 1 THEN 'X1' ELSE source_id END AS source_id, kind, CASE WHEN conv_id % 7 = 3 AND kind <> 'document' THEN repeat(content, 2000) ELSE content END AS content,
    CASE WHEN conv_id % 7 = 2 THEN sha256(content || 'x') WHEN conv_id % 7 = 3 AND kind <> 'document' THEN sha256(repeat(content, 2000)) ELSE content_sha256 END AS content_sha256, CASE WHEN kind = 'document' THEN 'exact' ELSE 'unavailable' END AS locator,
    CASE WHEN kind = 'document' THEN CAST(10 AS INTEGER) END AS start_char, CASE WHEN kind = 'document' THEN CAST(10 + length(content) + CASE WHEN conv_id % 7 = 4 THEN 1 ELSE 0 END AS INTEGER) END AS end_char FROM pack)"""


@query(f"""WITH {FAULTY} SELECT conv_id, COUNT(*) AS source_count, sha256(string_agg(concat_ws(':', ordinal, source_id, kind, content_sha256, locator, start_char, end_char), chr(10) ORDER BY ordinal)) AS canonical_sha256,
  CASE WHEN COUNT(*) > 64 THEN 'too many sources' WHEN bool_or(source_id = 'X1') THEN 'malformed id' WHEN bool_or(content_sha256 <> sha256(content)) THEN 'digest' WHEN bool_or(kind <> 'document' AND length(content) > 50000) THEN 'long snapshot'
    WHEN bool_or(kind = 'document' AND end_char - start_char <> length(content)) THEN 'locator' END AS fault FROM located GROUP BY 1""")
def gnd02_manifest(t):
    """Manifests of packs with locators, of which some can't be frozen, each for another reason."""
    k, other, document = F.col("conv_id") % 7, F.col("kind") != "document", F.col("kind") == "document"
    pack = _pack(t).withColumn("source_id", F.when(k == 1, "X1").otherwise(F.col("source_id")))
    long = F.when((k == 3) & other, F.repeat("content", F.lit(2_000))).otherwise(F.col("content"))
    pack = pack.withColumn("content_sha256", F.when(k == 2, F.sha2(F.concat("content", F.lit("x")).cast("binary"), 256)).otherwise(F.sha2(long.cast("binary"), 256))).withColumn("content", long)
    pack = pack.withColumn("locator", F.when(document, "exact").otherwise("unavailable")).withColumn("start_char", F.when(document, 10))
    pack = pack.withColumn("end_char", F.when(document, 10 + F.length("content") + F.when(k == 4, 1).otherwise(0)))
    return grounding.manifest(pack, "conv_id")


@query(f"""WITH {PACK}, m AS (SELECT conv_id, COUNT(*) AS source_count, sha256(string_agg(ordinal || ':' || source_id || ':' || kind || ':' || content_sha256, chr(10) ORDER BY ordinal)) AS canonical FROM pack GROUP BY 1),
  f AS (SELECT conv_id, COUNT(*) AS n FROM conversations WHERE text <> '' AND turn <> 3 GROUP BY 1) SELECT conv_id, COALESCE(n = source_count, FALSE) AS equal, CASE WHEN n = source_count THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM m LEFT JOIN f USING (conv_id)""")
def gnd08_11_replay(t):
    """A frozen manifest against one rebuilt from the rows as they are now, failed tools with them: equal digests score 1."""
    kind = F.when(F.col("role") == "user", "document").when(F.col("role") == "assistant", "memory").otherwise("tool")
    now_rows = t.conversations.select("conv_id", "turn", kind.alias("kind"), F.when(F.col("turn") == 3, "").otherwise(F.col("text")).alias("content"))
    rebuilt = grounding.manifest(grounding.evidence_pack(now_rows, "conv_id", "turn", "kind", "content"), "conv_id").select("conv_id", F.col("canonical_sha256").alias("again"))
    same = F.coalesce(F.col("canonical_sha256") == F.col("again"), F.lit(False))
    return grounding.manifest(_pack(t), "conv_id").join(rebuilt, "conv_id", "left").select("conv_id", same.alias("equal"), F.when(same, 1.0).otherwise(0.0).alias("score"))


SIG = "list_distinct([w FOR w IN string_split_regex(lower({0}), '[^\\pL\\pN]+') IF length(w) > 2 AND w NOT IN (" + ", ".join(repr(w) for w in grounding.STOP) + ")])"
#: An order's lines as evidence, a few sentences each, and a claim about each line that is right or wrong in one of seven ways. x: numbers of the claim, t: its negations.
LINES = """l AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q, l_partkey AS p, l_suppkey % 17 = 0 AS twice, CAST((l_orderkey + l_linenumber) % 7 AS INTEGER) AS kind,
    'Line ' || l_linenumber || ' ships ' || CAST(l_quantity AS INTEGER) || ' boxes of part ' || l_partkey || '.' || CASE WHEN l_returnflag = 'R' THEN ' It was not accepted by them.' WHEN l_returnflag = 'A' THEN ' Clerks wrote ''very' || chr(10) || ' fragile''!' ELSE '' END AS said FROM lineitem),
  evidence AS (SELECT l_orderkey, string_agg(said, ' ' ORDER BY n, said) AS content FROM l GROUP BY 1),
  claims AS (SELECT row_number() OVER () AS cid, l_orderkey, n, kind, CASE WHEN twice THEN ['D1', 'D1'] ELSE ['D1'] END AS sources,
    CASE kind WHEN 0 THEN 'Line ' || n || ' ships ' || q || ' boxes of part ' || p WHEN 1 THEN 'Line ' || n || ' ships ' || (q + 100000) || ' boxes' WHEN 2 THEN 'Line ' || n || ' never ships ' || q || ' boxes' WHEN 3 THEN 'Clouds drift quietly eastward'
      WHEN 4 THEN repeat('x', 1001) WHEN 5 THEN 'It was not accepted on line ' || n ELSE 'Clerks wrote "very fragile" about part ' || p END AS claim,
    CASE kind WHEN 0 THEN [CAST(n AS VARCHAR), CAST(q AS VARCHAR), CAST(p AS VARCHAR)] WHEN 1 THEN [CAST(n AS VARCHAR), CAST(q + 100000 AS VARCHAR)] WHEN 2 THEN [CAST(n AS VARCHAR), CAST(q AS VARCHAR)] WHEN 3 THEN [] WHEN 4 THEN [] WHEN 5 THEN [CAST(n AS VARCHAR)] ELSE [CAST(p AS VARCHAR), 'very fragile'] END AS x,
    CASE kind WHEN 2 THEN ['never'] WHEN 5 THEN ['not'] ELSE [] END AS t FROM l),
  plain AS (SELECT l_orderkey, content, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS c FROM evidence),
  cases AS (SELECT claims.*, content, c FROM claims JOIN plain USING (l_orderkey))"""


def _claims(t, facts):
    n, q, p = F.col("n").cast("string"), F.col("q"), F.col("p").cast("string")
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p"), "l_returnflag", (F.col("l_suppkey") % 17 == 0).alias("twice"))
    # An order has seven lines at most.
    orders = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("n", "q", "p", "l_returnflag", "twice")).alias("lines"))

    def said(x):
        after = F.when(x["l_returnflag"] == "R", " It was not accepted by them.").when(x["l_returnflag"] == "A", " Clerks wrote 'very\n fragile'!").otherwise("")
        return F.concat(F.lit("Line "), x["n"].cast("string"), F.lit(" ships "), x["q"].cast("string"), F.lit(" boxes of part "), x["p"].cast("string"), F.lit("."), after)

    placed = orders.withColumn("lines", F.array_sort(F.transform("lines", lambda x: F.struct(x["n"].alias("n"), said(x).alias("said"), x["q"].alias("q"), x["p"].alias("p"), x["twice"].alias("twice")))))
    content = placed.withColumn("content", F.array_join(F.transform("lines", lambda x: x["said"]), " "))
    # What is read of an order's content is made once for all its claims: here, or where they follow each other.
    sources = content if not facts else grounding.with_source_facts(content, "content")
    cases = sources.withColumn("line", F.explode("lines")).drop("lines").select("*", "line.n", "line.q", "line.p", "line.twice").drop("line")
    kind = ((F.col("l_orderkey") + F.col("n")) % 7).cast("int")
    claim = (
        F.when(kind == 0, F.concat(F.lit("Line "), n, F.lit(" ships "), q.cast("string"), F.lit(" boxes of part "), p))
        .when(kind == 1, F.concat(F.lit("Line "), n, F.lit(" ships "), (q + 100_000).cast("string"), F.lit(" boxes")))
        .when(kind == 2, F.concat(F.lit("Line "), n, F.lit(" never ships "), q.cast("string"), F.lit(" boxes")))
        .when(kind == 3, "Clouds drift quietly eastward")
        .when(kind == 4, F.repeat(F.lit("x"), 1_001))
        .when(kind == 5, F.concat(F.lit("It was not accepted on line "), n))
        .otherwise(F.concat(F.lit('Clerks wrote "very fragile" about part '), p))
    )
    sources = F.when(F.col("twice"), F.array(F.lit("D1"), F.lit("D1"))).otherwise(F.array(F.lit("D1")))
    return cases.withColumn("claim", claim).withColumn("sources", sources).drop("q", "p", "twice")


@query(f"""WITH {LINES}, k AS (SELECT *, {SIG.format('claim')} AS a, {SIG.format('content')} AS b FROM cases)
  SELECT l_orderkey, n, ROUND(CASE WHEN len(a) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(a) END, 4) AS coverage,
    CASE WHEN length(claim) > 1000 THEN 'claim size' WHEN len(sources) > len(list_distinct(sources)) THEN 'sources' WHEN len([y FOR y IN x IF NOT contains(c, y)]) > 0 THEN 'missing anchor'
      WHEN len(a) > 0 AND len(list_intersect(a, b)) / len(a) < 0.25 THEN 'low coverage' WHEN len([y FOR y IN t IF NOT list_contains(string_split(c, ' '), y)]) > 0 THEN 'polarity' ELSE 'passed' END AS verdict FROM k""")
def gnd03_claim_validation(t):
    """Claims about all lines of all orders, with every verdict among them."""
    return grounding.validate_claims(_claims(t, facts=True)).select("l_orderkey", "n", "coverage", "verdict")


@query(f"""WITH {LINES}, s0 AS (SELECT l_orderkey, unnest(string_split(regexp_replace(content, '([.!]) ', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(content, '([.!]) ', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM evidence),
  s AS (SELECT *, CAST(SUM(length(s) + 1) OVER (PARTITION BY l_orderkey ORDER BY i) AS BIGINT) - length(s) - 1 AS a FROM s0),
  w AS (SELECT x.l_orderkey, x.a AS start, y.a + length(y.s) AS stop FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.i <= y.i),
  v AS (SELECT w.*, substring(content, start + 1, stop - start) AS part FROM w JOIN evidence USING (l_orderkey)),
  z AS (SELECT *, {SIG.format('part')} AS words, trim(regexp_replace(lower(part), '\\s+', ' ', 'g')) AS pc FROM v),
  k AS (SELECT *, list_intersect({SIG.format('claim')}, {SIG.format('content')}) AS need, [y FOR y IN x IF contains(c, y)] AS held, [y FOR y IN t IF list_contains(string_split(c, ' '), y)] AS turns FROM cases),
  m AS (SELECT cid, MIN({{'n': stop - start, 'a': start, 'b': stop}}) AS best FROM k JOIN z USING (l_orderkey) WHERE len(need) + len(held) + len(turns) > 0 AND list_has_all(words, need) AND len([y FOR y IN held IF NOT contains(pc, y)]) = 0
    AND list_has_all(string_split(pc, ' '), turns) GROUP BY 1)
  SELECT l_orderkey, n, CAST(COALESCE(best.a, 0) AS INTEGER) AS start, CAST(COALESCE(best.b, length(content)) AS INTEGER) AS "end", CASE WHEN COALESCE(best.a, 0) > 0 OR COALESCE(best.b, length(content)) < length(content) THEN 'claim_aligned' ELSE 'full_chunk_fallback' END AS selection FROM k LEFT JOIN m USING (cid)""")
def gnd04_fn09_aligned_quote(t):
    """The shortest run of sentences for each of those claims, with numbers, quoted text over a line's end, and negations."""
    return grounding.aligned_quote(_claims(t, facts=False), "claim", "content").select("l_orderkey", "n", "start", "end", "selection")

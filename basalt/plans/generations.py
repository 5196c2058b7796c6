"""Generation lifecycle queries. Orders are generations of a customer's space, their lines the members, parts the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators import generations as G
from basalt.plans.registry import query
from basalt.tables import written

NOW = "TIMESTAMP '1998-06-01'"


def now():
    return F.to_timestamp_ntz(F.lit("1998-06-01"))


def days(n):
    return F.make_dt_interval(F.lit(n))


GENERATIONS = """gen0 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders),
  generations AS (SELECT o_orderkey AS id, o_custkey AS space, CASE WHEN o_orderkey % 2 = 0 THEN 'corpus_refresh' ELSE 'profile_change' END AS kind,
    CASE WHEN o_orderstatus = 'P' AND nth = 1 THEN 'active' WHEN o_orderstatus = 'P' THEN 'retired' WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'stale' WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'building' END AS status,
    CAST(o_orderkey % 3 AS BIGINT) AS revision, o_orderdate AS started, o_orderdate + INTERVAL 900 DAY AS retain_until, o_orderkey % 5 = 0 AS paused,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS baseline FROM gen0),
  corpus AS (SELECT c_custkey AS space, CAST(c_custkey % 3 AS BIGINT) AS revision, TIMESTAMP '1998-01-01' + to_days(CAST(c_custkey % 200 AS INTEGER)) AS changed FROM customer),
  members AS (SELECT l_orderkey AS generation, l_linenumber AS member, l_partkey AS chunk, sha256(CAST(l_partkey AS VARCHAR) || CASE WHEN l_suppkey % 40 = 0 THEN 'old' ELSE '' END) AS content_hash,
    CASE WHEN l_linestatus = 'F' OR l_quantity > 20 THEN 'embedded' WHEN l_returnflag = 'N' THEN 'processing' ELSE 'pending' END AS status, CASE WHEN l_returnflag = 'N' THEN 'w' || CAST(l_suppkey % 3 AS VARCHAR) END AS owner,
    CAST(l_linenumber AS INTEGER) AS attempts, l_shipdate AS due, CASE WHEN l_discount > 0.095 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM lineitem),
  chunks AS (SELECT p_partkey AS chunk, sha256(CAST(p_partkey AS VARCHAR)) AS content_hash FROM part)"""


def generations(t) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when((s == "P") & (F.col("nth") == 1), "active").when(s == "P", "retired").when(k % 7 == 0, "failed").when(k % 11 == 0, "stale").when(s == "F", "ready").otherwise("building")
    return t.orders.withColumn("nth", nth).select(
        k.alias("id"), F.col("o_custkey").alias("space"), F.when(k % 2 == 0, "corpus_refresh").otherwise("profile_change").alias("kind"), status.alias("status"), (k % 3).cast("long").alias("revision"),
        F.col("o_orderdate").alias("started"), (F.col("o_orderdate") + days(900)).alias("retain_until"), (k % 5 == 0).alias("paused"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("baseline"),
    )


def corpus(t) -> DataFrame:
    changed = F.to_timestamp_ntz(F.lit("1998-01-01")) + F.make_dt_interval((F.col("c_custkey") % 200).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("space"), (F.col("c_custkey") % 3).cast("long").alias("revision"), changed.alias("changed"))


def members(t, lines: DataFrame | None = None) -> DataFrame:
    """Of all lines, or those given."""
    flag = F.col("l_returnflag") == "N"
    status = F.when((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 20), "embedded").when(flag, "processing").otherwise("pending")
    content = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 40 == 0, "old").otherwise(""))
    return (t.lineitem if lines is None else lines).select(
        F.col("l_orderkey").alias("generation"), F.col("l_linenumber").alias("member"), F.col("l_partkey").alias("chunk"), F.sha2(content, 256).alias("content_hash"), status.alias("status"),
        F.when(flag, F.concat(F.lit("w"), (F.col("l_suppkey") % 3).cast("string"))).alias("owner"), F.col("l_linenumber").cast("int").alias("attempts"), F.col("l_shipdate").alias("due"), F.when(F.col("l_discount") > 0.095, 0.5).otherwise(1.0).alias("norm"),
    )


def chunks(t) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("chunk"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("content_hash"))


PART = "SUM(CASE WHEN status = 'embedded' THEN CAST('0x' || substr(d, {0}, 15) AS BIGINT) END)"
REPORTS = f"""joined AS (SELECT m.*, c.content_hash AS now_hash, sha256(CAST(m.chunk AS VARCHAR) || chr(31) || m.content_hash) AS d FROM members m LEFT JOIN chunks c USING (chunk)),
  faults AS (SELECT generation, COUNT(*) AS membership, COUNT(*) FILTER (WHERE status <> 'embedded') AS invalid_state, COUNT(*) FILTER (WHERE status = 'embedded' AND content_hash IS DISTINCT FROM now_hash) AS invalid_hash,
    COUNT(*) FILTER (WHERE status = 'embedded' AND ABS(norm - 1) > 0.001) AS invalid_norm,
    sha256(concat_ws(':', COUNT(*) FILTER (WHERE status = 'embedded'), {PART.format(1)}, {PART.format(16)}, {PART.format(31)}, {PART.format(46)})) AS fingerprint FROM joined GROUP BY 1),
  expected AS (SELECT o_orderkey AS generation, COUNT(l_orderkey) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS expected FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
  reports AS (SELECT generation, expected, COALESCE(membership, 0) AS membership, COALESCE(invalid_state, 0) AS invalid_state, COALESCE(invalid_hash, 0) AS invalid_hash, COALESCE(invalid_norm, 0) AS invalid_norm, fingerprint,
    COALESCE(membership, 0) = expected AND expected > 0 AND COALESCE(invalid_state + invalid_hash + invalid_norm, 0) = 0 AS approved FROM expected LEFT JOIN faults USING (generation))"""


def reports(t) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    expected = t.orders.join(lines, F.col("k") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("generation"), (F.coalesce("n", F.lit(0)) + F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("expected"))
    return G.qualify(members(t), chunks(t), expected)


@query(f"WITH {GENERATIONS}, {REPORTS} SELECT * FROM reports")
def agg19_20_ing18_qualify(t):
    return reports(t)


ASKED = "asked AS (SELECT space, id FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY started DESC, id DESC) AS r FROM generations WHERE status IN ('ready', 'building')) WHERE r = 1)"


@query(f"""WITH {GENERATIONS}, {REPORTS}, {ASKED}, judged AS (SELECT g.*, CASE WHEN a.id IS NULL THEN NULL WHEN g.status <> 'ready' THEN 'not ready' WHEN NOT COALESCE(approved, FALSE) THEN 'no approved report' WHEN g.revision IS DISTINCT FROM c.revision THEN 'another revision' ELSE 'activated' END AS reason
    FROM generations g LEFT JOIN asked a ON a.id = g.id LEFT JOIN reports r ON r.generation = g.id LEFT JOIN corpus c ON c.space = g.space),
  moved AS (SELECT space, id AS new_id FROM judged WHERE reason = 'activated')
  SELECT id, space, CASE WHEN id = new_id THEN 'active' WHEN status = 'active' AND new_id IS NOT NULL THEN 'retired' ELSE status END AS status, revision,
    CASE WHEN status = 'active' AND new_id IS NOT NULL THEN {NOW} + INTERVAL 7 DAY ELSE retain_until END AS retain_until, reason FROM judged LEFT JOIN moved USING (space)""")
def ing19_activate(t):
    g = generations(t)
    last = F.row_number().over(Window.partitionBy("space").orderBy(F.desc("started"), F.desc("id")))
    asked = g.where("status IN ('ready', 'building')").withColumn("r", last).where("r = 1").select("space", "id")
    return G.activate(g, reports(t), corpus(t), asked, now(), days(7))


@query(f"""WITH {GENERATIONS}, kept AS (SELECT g.space, g.id, row_number() OVER (PARTITION BY g.space ORDER BY g.retain_until DESC, g.id DESC) AS r FROM generations g JOIN corpus USING (space, revision) WHERE status = 'retired' AND retain_until > {NOW}),
  back AS (SELECT space, id AS back_id FROM kept WHERE r = 1 AND space IN (SELECT space FROM generations WHERE status = 'active'))
  SELECT id, space, CASE WHEN id = back_id THEN 'active' WHEN status = 'active' AND back_id IS NOT NULL THEN 'retired' ELSE status END AS status, back_id IS NOT NULL AS rolled_back FROM generations LEFT JOIN back USING (space)""")
def ing20_roll_back(t):
    return G.roll_back(generations(t), corpus(t), now())


@query(f"""WITH {GENERATIONS}, n AS (SELECT user_id AS space, COUNT(*) AS n FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY 1)
  SELECT g.id, g.space, CASE WHEN n IS NOT NULL AND status IN ('building', 'ready') THEN 'stale' ELSE status END AS status, CASE WHEN n IS NOT NULL AND status IN ('building', 'ready') THEN FALSE ELSE paused END AS paused, c.revision + COALESCE(n, 0) AS corpus_revision
  FROM generations g LEFT JOIN n USING (space) LEFT JOIN corpus c ON c.space = g.space""")
def ing21_corpus_bump(t):
    changes = t.events.where("event_type = 'purchase' AND value > 20").select(F.col("user_id").alias("space"))
    return G.bump(generations(t), corpus(t), changes)


BUSY = "busy AS (SELECT DISTINCT user_id AS space FROM events WHERE event_type = 'click' AND value > 60)"


@query(f"""WITH {GENERATIONS}, {BUSY}, active AS (SELECT space, id AS active_id, revision AS active_revision FROM generations WHERE status = 'active')
  SELECT c.space, active_id, active_revision, c.revision FROM corpus c JOIN active USING (space) WHERE active_revision < c.revision AND changed <= {NOW} - INTERVAL 30 DAY
  AND c.space NOT IN (SELECT space FROM generations WHERE status IN ('building', 'ready')) AND c.space NOT IN (SELECT space FROM busy) ORDER BY changed, c.space LIMIT 1""")
def ing22_refresh_candidate(t):
    busy = t.events.where("event_type = 'click' AND value > 60").select(F.col("user_id").alias("space"))
    return G.refresh_candidates(generations(t), corpus(t), busy, now(), days(30))


@query(f"""WITH {GENERATIONS}, {REPORTS}, known AS (SELECT DISTINCT m.chunk, m.content_hash FROM members m JOIN generations g ON g.id = m.generation WHERE g.status = 'active' AND m.status = 'embedded')
  SELECT m.generation, m.member, m.chunk, CASE WHEN k.chunk IS NOT NULL THEN 'reused' ELSE 'pending' END AS state FROM members m JOIN generations g ON g.id = m.generation AND g.status = 'building' LEFT JOIN known k ON k.chunk = m.chunk AND k.content_hash = m.content_hash""")
def ing23_reuse_vectors(t):
    g = written(generations(t).where("status IN ('building', 'active')").select("id", "status"), "generations")
    # Lines find their generation before they get hashes, so a shuffled row has a few numbers.
    of = lambda status: members(t, t.lineitem.join(g.where(F.col("status") == status).select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi"))
    return G.reuse(of("building").select("generation", "member", "chunk", "content_hash"), of("active").where("status = 'embedded'")).select("generation", "member", "chunk", "state")


@query(f"""WITH {GENERATIONS} SELECT g.id, CASE WHEN paused AND status IN ('building', 'ready') AND g.revision IS DISTINCT FROM c.revision THEN 'stale' ELSE status END AS status, CASE WHEN status IN ('building', 'ready') THEN FALSE ELSE paused END AS paused,
  CASE WHEN paused AND status IN ('building', 'ready') THEN g.revision IS NOT DISTINCT FROM c.revision END AS resumed FROM generations g LEFT JOIN corpus c USING (space)""")
def ing24_resume(t):
    return G.resume(generations(t), corpus(t))


@query(f"""WITH {GENERATIONS} SELECT g.id, g.space, g.baseline FROM generations g JOIN generations a ON a.space = g.space AND a.status = 'active' AND a.id = g.baseline WHERE g.status = 'ready' AND g.kind = 'corpus_refresh' AND NOT g.paused ORDER BY g.started, g.id LIMIT 1""")
def ing26_auto_activate(t):
    return G.auto_activation(generations(t))


@query(f"""WITH {GENERATIONS}, named AS (SELECT baseline FROM generations WHERE status NOT IN ('failed', 'stale') AND baseline IS NOT NULL)
  SELECT id, status FROM generations WHERE (status IN ('failed', 'stale') AND started < {NOW} - INTERVAL 400 DAY) OR (status = 'retired' AND retain_until <= {NOW} AND id NOT IN (SELECT baseline FROM named)) ORDER BY started, id LIMIT 200""")
def ing25_prune(t):
    return G.prune(generations(t), now(), days(400), 200)


CLAIMED = f"""held AS (SELECT m.*, g.space FROM members m JOIN generations g ON g.id = m.generation WHERE g.status = 'building' AND NOT g.paused),
  room AS (SELECT space, GREATEST(0, LEAST(3, 8 - COUNT(*) FILTER (WHERE status = 'processing' AND due > {NOW}))) AS room FROM held GROUP BY 1),
  free AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY due, generation, member) AS place FROM held WHERE due <= {NOW} AND status IN ('pending', 'processing') AND attempts < 5)"""


@query(f"""WITH {GENERATIONS}, {CLAIMED} SELECT space, generation, member, 'processing' AS status, 'me' AS owner, attempts + 1 AS attempts, {NOW} + INTERVAL 5 MINUTE AS due FROM free JOIN room USING (space) WHERE place <= room""")
def ing17_claim(t):
    return G.claim(members(t), generations(t), now(), 3, 8, 5, "me", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5)))


@query(f"""WITH {GENERATIONS}, results AS (SELECT l_orderkey AS generation, l_linenumber AS member, 'w' || CAST(l_linenumber % 3 AS VARCHAR) AS teller, l_quantity > 8 AS ok FROM lineitem WHERE l_returnflag = 'N'),
  heard AS (SELECT m.*, teller, ok, COALESCE(status = 'processing' AND owner = teller, FALSE) AS mine FROM members m LEFT JOIN results USING (generation, member))
  SELECT generation, member, CASE WHEN mine AND ok THEN 'embedded' WHEN mine AND attempts >= 3 THEN 'failed' WHEN mine THEN 'pending' ELSE status END AS status,
  CASE WHEN mine AND NOT ok AND attempts < 3 THEN {NOW} + to_seconds(LEAST(300, pow(2, LEAST(attempts, 8)))) ELSE due END AS due, CASE WHEN teller IS NULL THEN NULL WHEN mine THEN 'recorded' ELSE 'fenced' END AS verdict FROM heard""")
def ing13_17_record(t):
    said = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("generation"), F.col("l_linenumber").alias("member"), F.concat(F.lit("w"), (F.col("l_linenumber") % 3).cast("string")).alias("owner"), (F.col("l_quantity") > 8).alias("ok"))
    return G.record(members(t), said, now(), 3)


@query(f"WITH {GENERATIONS} SELECT space, id AS active_id, revision AS active_revision FROM generations WHERE status = 'active' AND kind = 'corpus_refresh'")
def ret03_active_generation(t):
    return G.active(generations(t).where("kind = 'corpus_refresh'"))

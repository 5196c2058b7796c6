"""Answers from evidence packs, stored-claim checks, spans, sets and lifecycle folds over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import text as X
from basalt.operators import graph, grounding, lifecycle, paging, retrieval
from basalt.plans.records import PACK, SIG, _pack
from basalt.plans.registry import query

FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) AS r FROM (SELECT *, MAX(CAST(kind = 'document' AS INTEGER)) OVER (PARTITION BY conv_id) AS has FROM pack) WHERE CAST(kind = 'document' AS INTEGER) = has)"


@query(f"""WITH {PACK}, {FIRST}, a AS (SELECT conv_id, left(string_agg(left(content, 900), chr(10) ORDER BY r), 900) AS answer FROM f WHERE r <= 3 GROUP BY 1)
  SELECT conv_id, md5(COALESCE(answer, '{grounding.ABSTAIN}')) AS answer FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN a USING (conv_id)""")
def gnd06_pack_answer(t):
    got = grounding.extractive_answer(_pack(t), t.conversations.select("conv_id").distinct(), "conv_id")
    return got.select("conv_id", F.md5(F.col("answer").cast("binary")).alias("answer"))


@query("""WITH c AS (SELECT l_orderkey AS g, l_linenumber AS claim_id, 'Claim ' || l_partkey || '.' AS text, l_quantity > 48 AS odd FROM lineitem), n AS (SELECT l_orderkey AS g, l_linenumber AS claim_id, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS number FROM lineitem WHERE l_returnflag <> 'N'),
  m AS (SELECT g, claim_id, string_agg('[' || number || ']', '' ORDER BY number) AS marks FROM (SELECT DISTINCT * FROM n) GROUP BY 1, 2), l AS (SELECT c.*, concat_ws(' ', text, marks) AS line FROM c LEFT JOIN m USING (g, claim_id))
  SELECT g, CASE WHEN bool_or(odd) THEN 'The evidence conflicts. ' ELSE '' END || string_agg(line, ' ' ORDER BY claim_id, line) AS answer FROM l GROUP BY 1""")
def gnd07_cited_answer(t):
    claims = t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("claim_id"), F.concat(F.lit("Claim "), F.col("l_partkey").cast("string"), F.lit(".")).alias("text"), (F.col("l_quantity") > 48).alias("odd"))
    number = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey"))
    cited = t.lineitem.where("l_returnflag != 'N'").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("claim_id"), number.alias("number"))
    return grounding.render_answer(claims, cited, "g", F.col("odd"))


STORED = """s AS (SELECT conv_id, source_id, content FROM pack), c AS (SELECT conv_id, ordinal AS claim_id, CASE WHEN ordinal % 6 = 0 THEN 'Q1' WHEN ordinal % 7 = 0 THEN 'D99' ELSE source_id END AS source_id, CAST(CASE WHEN ordinal % 5 = 0 THEN -1 ELSE 3 END AS INTEGER) AS start, 40 AS stop,
  substring(content, 4, 37) || CASE WHEN ordinal % 4 = 0 THEN '!' ELSE '' END AS quote, CASE WHEN ordinal % 3 = 0 THEN 'x' ELSE sha256(substring(content, 4, 37) || CASE WHEN ordinal % 4 = 0 THEN '!' ELSE '' END) END AS quote_sha256 FROM pack),
  h AS (SELECT c.*, s.content AS body FROM c LEFT JOIN s USING (conv_id, source_id))"""


@query(f"""WITH {PACK}, {STORED} SELECT conv_id, claim_id, 'unknown source' AS violation FROM h WHERE body IS NULL UNION ALL SELECT conv_id, claim_id, 'malformed id' FROM h WHERE NOT regexp_matches(source_id, '^[DMGT][1-9][0-9]{{0,2}}$')
  UNION ALL SELECT conv_id, claim_id, 'span' FROM h WHERE body IS NOT NULL AND (start < 0 OR stop <= start OR stop > length(body)) UNION ALL SELECT conv_id, claim_id, 'quote' FROM h WHERE body IS NOT NULL AND substring(body, start + 1, stop - start) <> quote AND start >= 0
  UNION ALL SELECT conv_id, claim_id, 'digest' FROM h WHERE quote_sha256 <> sha256(quote)""")
def gnd09_stored_claims(t):
    pack, n = _pack(t), F.col("ordinal")
    quote = F.concat(F.substring("content", 4, 37), F.when(n % 4 == 0, "!").otherwise(""))
    source = F.when(n % 6 == 0, "Q1").when(n % 7 == 0, "D99").otherwise(F.col("source_id"))
    claims = pack.select("conv_id", n.alias("claim_id"), source.alias("source_id"), F.when(n % 5 == 0, -1).otherwise(3).alias("start"), F.lit(40).alias("end"), quote.alias("quote"), F.when(n % 3 == 0, "x").otherwise(F.sha2(quote.cast("binary"), 256)).alias("quote_sha256"))
    return grounding.stored_violations(claims, pack, "conv_id")


@query(f"SELECT conv_id, turn, array_to_string(list_sort({SIG.format('text')}), ' ') AS tokens FROM conversations")
def fn16_significant_tokens(t):
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(grounding.significant(F.col("text"))), " ").alias("tokens"))


@query(r"""WITH p AS (SELECT doc_id, [trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))] AS s FROM documents)
  SELECT doc_id, len([x FOR x IN s IF x <> '']) AS sentences, CAST(COALESCE(list_sum([length(x) FOR x IN s]), 0) AS BIGINT) AS signs FROM p""")
def fn06_07_sentence_spans(t):
    spans = t.documents.select("doc_id", X.spans_between(F.col("text"), X.SENTENCE_GAP).alias("s"))
    return spans.select("doc_id", F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("signs"))


@query(r"""WITH p AS (SELECT doc_id, [trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN string_split_regex(text, '\n[ \t]*\n+')] AS s FROM documents)
  SELECT doc_id, len([x FOR x IN s IF x <> '']) AS paragraphs, CAST(COALESCE(list_sum([length(x) FOR x IN s]), 0) AS BIGINT) AS signs FROM p""")
def fn08_paragraph_spans(t):
    spans = t.documents.select("doc_id", X.spans_between(F.col("text"), X.PARAGRAPH_GAP).alias("s"))
    return spans.select("doc_id", F.size("s").cast("long").alias("paragraphs"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("signs"))


@query()
def fn15_anchors(t):
    return t.documents.select("doc_id", F.array_join(grounding.anchors(F.col("text")), "|").alias("anchors"))


@query(r"SELECT doc_id, array_to_string([k FOR k IN [CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'ssn' END, CASE WHEN regexp_matches(text, '\b(?:\d[ -]?){12,18}\d\b') THEN 'card' END] IF k IS NOT NULL], ',') AS kinds FROM documents")
def flt19_sensitive_kinds(t):
    return t.documents.select("doc_id", F.array_join(X.sensitive(F.col("text")), ",").alias("kinds"))


@query("""SELECT id, document, CASE WHEN id = winner THEN 'current' WHEN winner IS NOT NULL AND (status = 'current' OR (status = 'pending' AND ok)) THEN 'superseded' WHEN status = 'pending' AND NOT ok THEN 'failed' ELSE status END AS status FROM
  (SELECT *, MAX(CASE WHEN status = 'pending' AND ok THEN id END) OVER (PARTITION BY document) AS winner FROM (SELECT o_orderkey AS id, o_custkey AS document, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'pending' ELSE 'superseded' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice > 150000 END AS ok FROM orders))""")
def ing14_swap_derivations(t):
    status = F.when(F.col("o_orderstatus") == "F", "current").when(F.col("o_orderstatus") == "O", "pending").otherwise("superseded")
    derivations = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document"), status.alias("status"))
    finished = t.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 150_000).alias("ok"))
    return lifecycle.swap_derivations(derivations, finished)


@query("""WITH j AS (SELECT o_orderkey AS job, o_custkey AS document, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'obsolete' END AS state FROM orders),
  a AS (SELECT user_id AS document, arg_max(CASE event_type WHEN 'error' THEN 'delete' ELSE 'restore' END, {'t': ts, 'i': event_id}) AS action FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1)
  SELECT job, document, CASE WHEN action = 'delete' AND state IN ('pending', 'processing') THEN 'obsolete' WHEN action = 'restore' AND state = 'obsolete' THEN 'pending' ELSE state END AS state FROM j LEFT JOIN a USING (document)""")
def ing15_delete_restore_jobs(t):
    state = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "pending").otherwise("obsolete")
    jobs = t.orders.select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("document"), state.alias("state"))
    actions = t.events.where("event_type IN ('error', 'signup')").select(F.col("user_id").alias("document"), "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("restore").alias("action"))
    return lifecycle.delete_restore(jobs, actions, ["ts", "event_id"])


SIM = """near AS (SELECT vec_id, near, s FROM (SELECT a.vec_id, b.vec_id AS near, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE r = 1 AND s >= 0.35)"""


@query(f"""WITH RECURSIVE {SIM}, e AS (SELECT LEAST(vec_id, near) AS a, GREATEST(vec_id, near) AS b FROM near UNION SELECT GREATEST(vec_id, near), LEAST(vec_id, near) FROM near), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), c AS (SELECT node, MIN(seen) AS cluster FROM r GROUP BY 1)
  SELECT cluster, COUNT(*) AS size, (SELECT COUNT(*) FROM e WHERE a < b) AS pairs FROM c GROUP BY 1""")
def ret12_similar_clusters(t):
    near = retrieval.nearest_in_group(t.embeddings, "vec_id", "label", "embedding").where("likeness >= 0.35")
    pairs = near.select(F.least("vec_id", "near").alias("a"), F.greatest("vec_id", "near").alias("b")).distinct()
    sizes = graph.clusters(pairs).groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("pairs"))))  # one row


@query("""SELECT o_custkey AS customer, side FROM (SELECT o_custkey, 'left' AS side FROM orders WHERE year(o_orderdate) = 1996 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) UNION SELECT o_custkey, 'right' FROM orders WHERE year(o_orderdate) = 1997 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996))""")
def set04_changed_customers(t):
    of = lambda y: t.orders.where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("customer"))
    a, b = of(1996), of(1997)
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


FEED = "(SELECT {0} AS kind, {1} AS id, {2} AS moment FROM {3} ORDER BY {2} DESC, {1} LIMIT 8)"
BRANCHES = [("orders", "o_orderkey", "o_orderdate"), ("events", "event_id", "ts"), ("lineitem", "l_orderkey * 10 + l_linenumber", "l_shipdate"), ("documents", "doc_id", "TIMESTAMP '2024-01-01' + to_hours(doc_id)"), ("customer", "c_custkey", "TIMESTAMP '2024-01-10' + to_minutes(c_custkey)")]


@query("SELECT kind, id, moment FROM (" + " UNION ALL ".join(FEED.format(repr(n), k, at, n) for n, k, at in BRANCHES) + ") ORDER BY moment DESC, kind, id LIMIT 12")
def set01_five_branch_feed(t):
    def branch(name, key, at):
        return getattr(t, name).select(F.lit(name).alias("kind"), key.cast("long").alias("id"), at.alias("moment")).orderBy(F.desc("moment"), "id").limit(8)

    after = lambda day, step: F.to_timestamp_ntz(F.lit(day)) + step
    zero = F.lit(0)
    feed = paging.union_all(
        branch("orders", F.col("o_orderkey"), F.col("o_orderdate")),
        branch("events", F.col("event_id"), F.col("ts")),
        branch("lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_shipdate")),
        branch("documents", F.col("doc_id"), after("2024-01-01", F.make_dt_interval(zero, F.col("doc_id").cast("int")))),
        branch("customer", F.col("c_custkey"), after("2024-01-10", F.make_dt_interval(zero, zero, F.col("c_custkey").cast("int")))),
    )
    return feed.orderBy(F.desc("moment"), "kind", "id").limit(12)


WEB = """edges AS (SELECT 'd' || l_orderkey AS a, 'e' || l_partkey AS b, COUNT(*) AS frequency FROM lineitem GROUP BY 1, 2), e AS (SELECT a AS x, b AS y FROM edges UNION ALL SELECT b, a FROM edges),
  r0 AS (SELECT 'e1' AS node, 0 AS depth UNION ALL SELECT 'e2', 0), r1 AS (SELECT * FROM r0 UNION ALL SELECT y, 1 FROM e JOIN r0 ON x = node), r2 AS (SELECT * FROM r1 UNION ALL SELECT y, 2 FROM e JOIN r1 ON x = node WHERE depth = 1),
  n0 AS (SELECT node, CAST(MIN(depth) AS INTEGER) AS depth FROM r2 GROUP BY 1), n1 AS (SELECT n0.*, (SELECT COUNT(*) FROM e WHERE x = node) AS links FROM n0),
  nodes AS (SELECT *, CAST(row_number() OVER (ORDER BY depth, links DESC, node) AS INTEGER) AS place, COUNT(*) OVER () > 40 AS truncated FROM n1)"""


def _web(t):
    k = F.col
    web = t.lineitem.groupBy(F.concat(F.lit("d"), k("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("e"), k("l_partkey").cast("string")).alias("b")).agg(F.count("*").alias("frequency"))
    roots = t.part.where("p_partkey IN (1, 2)").select(F.concat(F.lit("e"), k("p_partkey").cast("string")).alias("node"))
    return graph.projection(web, roots, 1, 40, 30)


@query(f"WITH {WEB} SELECT * FROM nodes WHERE place <= 40")
def ret17_projected_nodes(t):
    return _web(t)[0]


@query(f"""WITH {WEB}, k AS (SELECT node FROM nodes WHERE place <= 40), l AS (SELECT a, b, frequency, row_number() OVER (ORDER BY frequency DESC, a, b) AS r, COUNT(*) OVER () > 30 AS truncated FROM edges WHERE a IN (SELECT node FROM k) AND b IN (SELECT node FROM k))
  SELECT a, b, frequency, truncated FROM l WHERE r <= 30""")
def ret17_projected_links(t):
    return _web(t)[1]

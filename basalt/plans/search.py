"""Filters, joins, text functions, retrieval and graph queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as X
from basalt.operators import fulltext, graph, paging, ranges, records, retrieval, temporal
from basalt.plans.registry import query
from basalt.tables import dealt

VERSIONS = """versions AS (SELECT doc_id AS version_id, source || '/' || lang AS document, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS INTEGER) AS version_number,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS recorded_at, CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2020-01-01' + to_days(CAST(doc_id * 2 AS INTEGER)) END AS source_time FROM documents)"""


def versions(t) -> DataFrame:
    """The document table read as versions of one document for each source and language."""
    hour = F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))
    day = F.make_dt_interval((F.col("doc_id") * 2).cast("int"))
    number = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    base = lambda x: F.to_timestamp_ntz(F.lit(x))
    return t.documents.select(F.col("doc_id").alias("version_id"), F.concat_ws("/", "source", "lang").alias("document"), number.alias("version_number"), (base("2024-01-01") + hour).alias("recorded_at"), F.when(F.col("doc_id") % 3 != 0, base("2020-01-01") + day).alias("source_time"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'src1' AND lang = 'en' AND n_chars > 100")
def flt01_scope(t):
    return t.documents.where("source = 'src1' AND lang = 'en' AND n_chars > 100").select("doc_id", "n_chars")


@query("SELECT doc_id, 'src1' AS seen_by FROM documents WHERE source = 'src1'")
def flt02_session_scope(t):
    """What two sessions see: one of the identity src1, one without an identity, which sees nothing."""
    seen = [temporal.scoped(t.documents, "source", who).select("doc_id", F.lit(who).cast("string").alias("seen_by")) for who in ("src1", None)]
    return paging.union_all(*seen)


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def flt03_join01_eligible(t):
    good = t.customer.where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select("c_custkey")
    return t.orders.where("o_orderstatus = 'F'").join(good, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (3, 5, 8, 13, 21)")
def flt04_allow_list(t):
    return t.documents.where(F.col("doc_id").isin(3, 5, 8, 13, 21)).select("doc_id")


@query("SELECT p_partkey FROM part WHERE lower(trim(p_brand)) IN (SELECT lower(p_brand) FROM part WHERE p_partkey IN (1, 2, 3))")
def flt05_title_filter(t):
    wanted = t.part.where(F.col("p_partkey").isin(1, 2, 3)).select(F.lower("p_brand").alias("k")).distinct()
    return t.part.withColumn("k", F.lower(F.trim("p_brand"))).join(wanted, "k", "left_semi").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1996, 1999)")
def flt06_exact_years(t):
    return t.orders.where(temporal.temporal_filter(F.col("o_orderdate"), years=[1996, 1999])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def flt07_year_range(t):
    return t.orders.where(temporal.temporal_filter(F.col("o_orderdate"), year_range=(1997, 1998))).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-06 18:00:00'")
def flt08_window(t):
    return t.events.where(temporal.temporal_filter(F.col("ts"), window=("2024-01-05 06:00:00", "2024-01-06 18:00:00"))).select("event_id")


@query(f"""WITH {VERSIONS} SELECT version_id, COALESCE(source_time, recorded_at) AS effective FROM versions WHERE COALESCE(source_time, recorded_at) < TIMESTAMP '2022-01-01'""")
def flt10_authority(t):
    return versions(t).select("version_id", temporal.authority("effective").alias("effective")).where(temporal.temporal_filter(F.col("effective"), window=(None, "2022-01-01")))


@query(f"WITH {VERSIONS} SELECT version_id, version_number = MAX(version_number) OVER (PARTITION BY document) AS is_current_version FROM versions")
def flt11_prj01_current_version(t):
    return versions(t).select("version_id", (F.col("version_number") == F.max("version_number").over(Window.partitionBy("document"))).alias("is_current_version"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under the apache')")
def flt13_ret05_phrase(t):
    return t.documents.where(F.instr(F.lower("text"), "licensed under the apache") > 0).select("doc_id")


@query("SELECT source FROM documents GROUP BY 1 HAVING list_contains(list(lang), 'es')")
def flt14_tag_contains(t):
    return t.documents.groupBy("source").agg(F.collect_set("lang").alias("tags")).where(F.array_contains("tags", "es")).select("source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS DISTINCT FROM NULLIF(l_linestatus, 'O')")
def flt17_null_safe(t):
    a, b = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))
    return t.lineitem.where(~a.eqNullSafe(b)).select("l_orderkey", "l_linenumber")


@query("SELECT page_id, regexp_matches(p, '^/') AND NOT regexp_matches(p, '^//') AND length(p) <= 500 AS same_origin FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS p FROM pages)")
def flt18_same_origin(t):
    return t.pages.select("page_id", F.coalesce(X.same_origin(F.regexp_replace("url", "^https?:/", "")), F.lit(False)).alias("same_origin"))


@query(r"SELECT doc_id, regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') AS ssn FROM documents WHERE regexp_matches(text, '\d{3}-\d{2}-\d{4}')")
def flt19_sensitive(t):
    return t.documents.where(F.col("text").rlike(r"\d{3}-\d{2}-\d{4}")).select("doc_id", F.array_contains(X.sensitive(F.col("text")), "ssn").alias("ssn"))


RULES = [("always", ""), ("tag_contains", "USER"), ("tag_contains", "t2"), ("mime_type_equals", "text/assistant")]


@query("""SELECT conv_id, turn, r.kind || ':' || r.arg AS rule FROM conversations JOIN (VALUES ('always', ''), ('tag_contains', 'USER'), ('tag_contains', 't2'), ('mime_type_equals', 'text/assistant')) r(kind, arg)
  ON r.kind = 'always' OR (r.kind = 'tag_contains' AND (lower(r.arg) = lower(role) OR lower(r.arg) = 't' || turn)) OR (r.kind = 'mime_type_equals' AND r.arg = 'text/' || role)""")
def flt21_join11_rules(t):
    """Events with tags and a type against rules of every kind."""
    rules = t.spark.createDataFrame(RULES, "kind string, arg string")
    events = t.conversations.select("conv_id", "turn", F.array(F.initcap("role"), F.concat(F.lit("T"), F.col("turn").cast("string"))).alias("tags"), F.concat(F.lit("text/"), "role").alias("mime"))
    hit = records.rule_matches(F.col("kind"), F.col("arg"), F.col("tags"), F.col("mime"))
    return events.crossJoin(F.broadcast(rules)).where(hit).select("conv_id", "turn", F.concat_ws(":", "kind", "arg").alias("rule"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, GREATEST(o_custkey, 700) AS g, LEAST(o_custkey, 700) AS l, LEFT(o_orderpriority, 3) || '/' || o_orderstatus AS label FROM orders")
def prj02_expressions(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "large").otherwise("small").alias("size"), F.greatest("o_custkey", F.lit(700)).alias("g"), F.least("o_custkey", F.lit(700)).alias("l"), F.concat_ws("/", F.substring("o_orderpriority", 1, 3), "o_orderstatus").alias("label"))


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) r FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey AND r = 1")
def join02_left_best(t):
    best = paging.latest(t.lineitem.where("l_returnflag = 'R'"), ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber")])
    return t.orders.join(best, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "l_linenumber")


@query("SELECT event_id, date_diff('day', CAST(ts AS DATE), m.d) AS age_days FROM events, (SELECT CAST(MAX(ts) AS DATE) AS d FROM events) m")
def join03_single_row(t):
    last = t.events.agg(F.to_date(F.max("ts")).alias("d"))  # one row
    return t.events.crossJoin(F.broadcast(last)).select("event_id", F.datediff("d", F.to_date("ts")).cast("long").alias("age_days"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join04_exists(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join05_14_not_exists(t):
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query(f"""WITH {VERSIONS} SELECT document, version_id, version_number FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY recorded_at DESC, version_number DESC, version_id DESC) r
  FROM versions WHERE recorded_at < TIMESTAMP '2024-01-20') WHERE r = 1""")
def join06_win06_as_of_versions(t):
    return temporal.as_of(versions(t), "document", temporal.authority("recorded"), "2024-01-20", "version_number", "version_id").select("document", "version_id", "version_number")


@query("""SELECT event_id, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate = (SELECT MAX(o_orderdate) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderdate < e.ts - INTERVAL 9000 DAY)) AS asof_price
  FROM events e""")
def join06_as_of_join(t):
    left = t.events.select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("INTERVAL 9000 DAY")).alias("at"))
    right = t.orders.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t")).agg(F.max("o_totalprice").alias("price"))
    return temporal.asof_join(left, right, "k", "at", "t", "price").select("event_id", "asof_price")


NEAREST = """SELECT vec_id, near FROM (SELECT a.vec_id, b.vec_id AS near, row_number() OVER (PARTITION BY a.vec_id ORDER BY ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) DESC, b.vec_id) AS r
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE r = 1"""


@query(NEAREST)
def join07_nearest_memory(t):
    return retrieval.nearest_in_group(t.embeddings, "vec_id", "label", "embedding").select("vec_id", "near")


@query("SELECT l_orderkey, l_linenumber, COALESCE(o_totalprice, l_extendedprice) AS price FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def join09_reuse(t):
    approved = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return t.lineitem.join(approved, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("o_totalprice", "l_extendedprice").alias("price"))


@query("SELECT r.k, c_name FROM (SELECT unnest([1, 2, 3]) AS k, unnest(['x', 'y', 'z']) AS v) r JOIN customer ON c_custkey = r.k WHERE r.v <> 'y'")
def join10_parallel_unnest(t):
    zipped = t.spark.range(1).select(F.explode(F.arrays_zip(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("k"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("v"))).alias("r")).select("r.k", "r.v").where("v != 'y'")
    return zipped.join(t.customer, F.col("c_custkey") == F.col("k")).select("k", "c_name")


@query("SELECT s_suppkey, COUNT(*) AS hits FROM (SELECT l_orderkey, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1) JOIN supplier ON list_contains(ids, s_suppkey) GROUP BY 1")
def join12_membership(t):
    targets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids")).select(F.explode("ids").alias("s_suppkey"))
    return targets.join(t.supplier, "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("hits"))


@query("SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done FROM customer")
def join15_counts(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    return t.customer.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("f", F.lit(0)).alias("done"))


@query("SELECT p_partkey, COALESCE(n.price, p_retailprice) AS price FROM part LEFT JOIN (SELECT l_partkey, ROUND(MAX(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 40 GROUP BY 1) n ON l_partkey = p_partkey")
def join16_update_from(t):
    new = t.lineitem.where("l_quantity > 40").groupBy("l_partkey").agg(F.round(F.max("l_extendedprice"), 2).alias("price"))
    return t.part.join(new, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("price", "p_retailprice").alias("price"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def join17_containment(t):
    return fulltext.contained(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("quote")), "doc_id").select("doc_id", "item_id")


@query("""WITH l AS (SELECT row_number() OVER () AS id, l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem), r AS (SELECT o_orderkey * 2 + x AS request, o_orderkey, o_custkey % 40 + x * 3 AS a, o_custkey % 40 + x * 3 + 6 - x * 2 AS b FROM orders, (SELECT unnest([0, 1]) AS x)),
  o AS (SELECT request, COUNT(*) AS n FROM r JOIN l ON l.l_orderkey = r.o_orderkey AND q < b AND q + 8 > a GROUP BY 1), p AS (SELECT request, o_orderkey, unnest(range(a, b)) AS place FROM r),
  c AS (SELECT request, COUNT(DISTINCT place) AS covered FROM p JOIN l ON l.l_orderkey = p.o_orderkey AND q <= place AND q + 8 > place GROUP BY 1)
  SELECT request, COALESCE(n, 0) AS "overlaps", COALESCE(covered, 0) AS covered, COALESCE(covered, 0) = b - a AS complete FROM r LEFT JOIN o USING (request) LEFT JOIN c USING (request)""")
def join18_coverage(t):
    """Two ranges of each order against the spans of its lines: covered whole, in part, or not at all."""
    spans = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity").cast("long") + 8).alias("b"))
    x = t.orders.withColumn("x", F.explode(F.array(F.lit(0), F.lit(1))))
    a = F.col("o_custkey") % 40 + F.col("x") * 3
    requests = x.select((F.col("o_orderkey") * 2 + F.col("x")).alias("request"), F.col("o_orderkey").alias("l_orderkey"), a.alias("a"), (a + 6 - F.col("x") * 2).alias("b"))
    return ranges.coverage(requests, spans, "request", "l_orderkey")


@query("""SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
  AND a.l_shipdate < b.l_shipdate + INTERVAL 3 DAY AND a.l_shipdate + INTERVAL 3 DAY > b.l_shipdate""")
def join18_range_overlap(t):
    spans = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAY")).alias("e"))
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.s") < F.col("b.e")) & (F.col("a.e") > F.col("b.s"))
    return a.join(b, near).select("a.l_orderkey", F.col("a.l_linenumber").alias("a"), F.col("b.l_linenumber").alias("b"))


@query("SELECT 'degraded' AS status, o_orderkey FROM (SELECT 1) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice < 0) ON TRUE")
def join19_status_row(t):
    one = t.spark.range(1).select(F.lit("degraded").alias("status"), F.lit(1).alias("k"))
    return one.join(t.orders.where("o_totalprice < 0").select("o_orderkey", F.lit(1).alias("k")), "k", "left").select("status", "o_orderkey")


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def join20_any_exists(t):
    used = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).union(t.supplier.where("s_acctbal > 9000").select("s_nationkey")).distinct()
    return t.nation.join(used, F.col("n_nationkey") == F.col("k"), "left_semi").select("n_nationkey")


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0b\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'))) AS compact_md5 FROM documents")
def fn01_compact(t):
    return t.documents.select("doc_id", F.md5(X.compact(F.col("text")).cast("binary")).alias("compact_md5"))


@query(r"SELECT p_partkey, replace(replace(replace(p_name || '%_', '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM part")
def fn03_escape_like(t):
    return t.part.select("p_partkey", X.escape_like(F.concat("p_name", F.lit("%_"))).alias("pattern"))


@query(r"SELECT doc_id, CAST(GREATEST(1, FLOOR(len([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']) * 1.3::DOUBLE)) AS INTEGER) AS tokens FROM documents")
def fn05_estimate_tokens(t):
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substring(text, 11, 40) AS span, substring(text, GREATEST(1, 11 - 32), LEAST(32, 10)) AS prefix, substring(text, 51, 32) AS suffix FROM documents")
def fn10_span(t):
    return t.documents.select("doc_id", F.substring("text", 11, 40).alias("span"), F.substring("text", 1, 10).alias("prefix"), F.substring("text", 51, 32).alias("suffix"))


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS INTEGER) AS bytes FROM documents")
def fn22_src07_hash(t):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").alias("bytes"))


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority ELSE regexp_replace(LEFT(o_orderpriority, 6), '\\s\\S*$', '') || '…' END AS summary FROM orders".replace("\\\\", "\\"))
def fn32_summary(t):
    return t.orders.select("o_orderkey", X.summary(F.col("o_orderpriority"), 6).alias("summary"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'text' WHEN page_id % 4 = 1 THEN 'markdown' WHEN page_id % 4 = 2 THEN NULL ELSE 'pdf' END AS parser FROM pages""")
def src06_parser_dispatch(t):
    name = F.element_at(F.array(F.lit("a.TXT"), F.lit("b.md"), F.lit("c.html"), F.lit("d")), (F.col("page_id") % 4 + 1).cast("int"))
    mime = F.when(F.col("page_id") % 4 == 3, "application/pdf").otherwise("text/plain")
    return t.pages.select("page_id", X.parser_kind(name, mime).alias("parser"))


STOP = ["the", "of", "and", "to", "in", "de", "la", "der"]
TERMS = "list_distinct([w FOR w IN regexp_split_to_array(lower({0}), '[^a-z0-9_''-]+') IF length(w) > 1 AND w NOT IN ('the', 'of', 'and', 'to', 'in', 'de', 'la', 'der')])"


@query(f"""SELECT doc_id, ROUND(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / sqrt(len(a) * len(b)) END, 6) AS score
  FROM (SELECT doc_id, {TERMS.format('text')} AS a, {TERMS.format("'that and onesen with it from are ea this for'")} AS b FROM documents)""")
def fn17_set06_lexical_score(t):
    q = retrieval.lexical_terms(F.lit("that and onesen with it from are ea this for"), STOP)
    return t.documents.select("doc_id", retrieval.lexical_terms(F.col("text"), STOP).alias("a"), q.alias("b")).select("doc_id", F.round(retrieval.lexical_score(F.col("a"), F.col("b")), 6).alias("score"))


COSINE = "ROUND(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


def _query_vector(t, vec_id: int = 0) -> DataFrame:
    """One row with the vector q."""
    return t.embeddings.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


@query(f"SELECT vec_id, similarity FROM (SELECT e.vec_id, {COSINE} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label < 8 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 20) WHERE similarity >= 0.1")
def ret01_fn18_top04_dense(t):
    got = retrieval.dense(t.embeddings.where("label < 8"), _query_vector(t), 20, 0.1)
    return got.select("vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"""WITH m AS (SELECT *, CASE WHEN label % 3 = 0 THEN 'embedded' ELSE 'pending' END AS status FROM embeddings WHERE label < 6),
  c AS (SELECT vec_id, embedding FROM m WHERE status = 'embedded' UNION ALL SELECT vec_id, embedding FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM m))
  SELECT e.vec_id, {COSINE} AS similarity FROM c e, embeddings q WHERE q.vec_id = 0 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 20""")
def ret02_top05_generation_delta(t):
    members = t.embeddings.where("label < 6").withColumn("status", F.when(F.col("label") % 3 == 0, "embedded").otherwise("pending")).withColumn("is_serving", F.lit(True))
    return retrieval.dense_with_generation(t.embeddings, members, _query_vector(t), 20).select("vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"""WITH h AS (SELECT e.vec_id, {COSINE} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) >= 0.15 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 5)
  SELECT vec_id, similarity, label + CASE WHEN similarity IS NULL THEN 0 ELSE 1 END AS access_count FROM embeddings LEFT JOIN h USING (vec_id)""")
def ret09_memory(t):
    """Recalled memories (the threshold before the limit), and all memories with the count of their recalls."""
    hits, after = retrieval.recall_memories(t.embeddings.withColumn("access_count", F.col("label")), _query_vector(t), "vec_id", "embedding", 0.15)
    return after.join(hits, "vec_id", "left").select("vec_id", F.round("similarity", 6).alias("similarity"), "access_count")


RANKINGS = """rankings AS (SELECT user_id % 5 AS q, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS ranking_no, CAST(event_id % 40 AS VARCHAR) AS item,
  CAST(row_number() OVER (PARTITION BY user_id % 5, CASE event_type WHEN 'click' THEN 0 ELSE 1 END ORDER BY event_id) AS INTEGER) AS rank FROM events WHERE event_type IN ('click', 'purchase'))"""


@query(f"""WITH {RANKINGS}, s AS (SELECT q, ranking_no, item, MIN(rank) AS rank FROM rankings GROUP BY 1, 2, 3),
  f AS (SELECT q, item, SUM(1.0::DOUBLE / (60 + rank)) AS score, MIN({{'n': ranking_no, 'r': rank}}) AS first FROM s GROUP BY 1, 2)
  SELECT q, item, ROUND(score, 9) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY ROUND(score, 12) DESC, first, item) AS INTEGER) AS position FROM f""")
def ret07_win08_rank_fusion(t):
    no = F.when(F.col("event_type") == "click", 0).otherwise(1)
    rows = t.events.where(F.col("event_type").isin("click", "purchase")).select((F.col("user_id") % 5).alias("q"), no.alias("ranking_no"), (F.col("event_id") % 40).cast("string").alias("item"), "event_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q", "ranking_no").orderBy("event_id")))
    return retrieval.reciprocal_rank_fusion(ranked, "q", "item")


@query("""WITH r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20),
  l AS (SELECT doc_id, 1 AS part, doc_id AS place FROM documents WHERE contains(lower(text), 'the and attion') ORDER BY doc_id LIMIT 20), u AS (SELECT doc_id, 0 AS part, rank AS place FROM r UNION ALL SELECT * FROM l)
  SELECT doc_id, CAST(row_number() OVER (ORDER BY p, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, MIN({'a': part, 'b': place}) AS p FROM u GROUP BY 1)""")
def ret06_set05_keyword(t):
    longest = t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    ranked = longest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).select("doc_id", "rank")  # 20 rows
    return retrieval.keyword(t.documents, ranked, "the and attion", "doc_id", "text", 20)


@query("""WITH RECURSIVE n AS (""" + NEAREST + """), e AS (SELECT LEAST(vec_id, near) AS a, GREATEST(vec_id, near) AS b FROM n UNION SELECT GREATEST(vec_id, near), LEAST(vec_id, near) FROM n),
  r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node AS vec_id, MIN(seen) AS cluster FROM r GROUP BY 1""")
def ret12_reflection_clusters(t):
    near = retrieval.nearest_in_group(t.embeddings, "vec_id", "label", "embedding")
    return graph.clusters(near.select(F.col("vec_id").alias("a"), F.col("near").alias("b"))).select(F.col("node").alias("vec_id"), "cluster")


EDGES = "edges AS (SELECT l_orderkey AS document, l_partkey AS entity, CAST(SUM(l_quantity) AS BIGINT) AS frequency FROM lineitem GROUP BY 1, 2)"


def edges(t) -> DataFrame:
    rows = dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", "l_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("entity")).agg(F.sum("l_quantity").cast("long").alias("frequency"))


@query(f"WITH {EDGES} SELECT entity, CAST(SUM(frequency) AS BIGINT) AS mention_count, COUNT(DISTINCT document) AS document_count FROM edges GROUP BY 1")
def agg23_entity_degrees(t):
    return graph.degrees(edges(t))


HOP = "SELECT x.document, x.entity AS root, y.entity AS target, y.frequency FROM edges x JOIN edges y ON x.document = y.document AND x.entity <> y.entity WHERE x.entity IN (SELECT entity FROM {0}) ORDER BY y.frequency DESC, x.document, x.entity, y.entity LIMIT 40"


@query(f"WITH {EDGES}, roots AS (SELECT unnest([1, 2, 3]) AS entity) {HOP.format('roots')}")
def ret14_join13_neighbours(t):
    return graph.neighbours(edges(t), t.part.where("p_partkey BETWEEN 1 AND 3").select(F.col("p_partkey").alias("entity")))


@query(f"""WITH {EDGES.replace('edges AS', 'every_edge AS', 1)}, edges AS (SELECT * FROM every_edge WHERE document IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')), roots AS (SELECT unnest([1, 2, 3]) AS entity), one AS (SELECT * FROM ({HOP.format('roots')}) WHERE target NOT IN (SELECT entity FROM roots)),
  mid AS (SELECT DISTINCT target AS entity FROM one), two AS (SELECT * FROM ({HOP.format('mid')}) WHERE target NOT IN (SELECT entity FROM roots))
  SELECT document, LEAST(root, target) AS a, GREATEST(root, target) AS b, MIN(hop) AS hop FROM (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two) WHERE document IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY 1, 2, 3""")
def ret15_traverse(t):
    """Two hops over authorised documents, held against the authorisations of now before they are returned."""
    document = F.col("o_orderkey").alias("document")
    roots = t.part.where("p_partkey BETWEEN 1 AND 3").select(F.col("p_partkey").alias("entity"))
    return graph.traverse(edges(t), roots, 40, t.orders.where("o_orderstatus != 'P'").select(document), t.orders.where("o_orderpriority != '1-URGENT'").select(document))


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT 'd' || document AS a, 'e' || entity AS b FROM edges UNION ALL SELECT 'e' || entity, 'd' || document FROM edges),
  r(node, depth) AS (SELECT 'e1', 0 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 3) SELECT node, CAST(MIN(depth) AS INTEGER) AS depth FROM r GROUP BY 1""")
def ret17_reach(t):
    bipartite = edges(t).select(F.concat(F.lit("d"), F.col("document")).alias("a"), F.concat(F.lit("e"), F.col("entity")).alias("b"))
    return graph.reach(bipartite, t.spark.range(1).select(F.lit("e1").alias("node")), 3)


@query(f"""WITH {EDGES}, asked AS (SELECT o_orderkey AS document, o_orderstatus <> 'P' AS ok FROM orders WHERE o_orderkey % 25 = 0), n AS (SELECT document, COUNT(*) AS n FROM edges GROUP BY 1)
  SELECT a.document, NOT (ok AND COALESCE(n, 0) <= 5) AS degraded, e.entity, e.frequency FROM asked a LEFT JOIN n USING (document) LEFT JOIN edges e ON e.document = a.document AND ok AND n <= 5""")
def ret22_document_entities(t):
    """Each asked document's entities; a document with more than five, or one that may not be read, is degraded and empty."""
    asked = t.orders.where("o_orderkey % 25 = 0").select(F.col("o_orderkey").alias("document"))
    return graph.document_entities(edges(t), asked, t.orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("document")), 5)


@query(f"WITH {EDGES}, m AS (SELECT document, entity, frequency, p_brand FROM edges JOIN part ON p_partkey = entity WHERE p_size > 40) SELECT *, (SELECT COUNT(*) FROM m) > 2000 AS truncated FROM m ORDER BY frequency DESC, document, p_brand, entity LIMIT 2000")
def ret23_mention_scan(t):
    """The most frequent mentions of some entities, with a probe that tells whether there are more."""
    named = edges(t).join(t.part.where("p_size > 40").select(F.col("p_partkey").alias("entity"), "p_brand"), "entity")
    return graph.mention_scan(named, [F.desc("frequency"), F.asc("document"), F.asc("p_brand"), F.asc("entity")], 2_000).select("document", "entity", "frequency", "p_brand", "truncated")


AUTHORISED = """p AS (SELECT o_orderkey AS document, o_orderkey % 4 AS version, o_orderkey % 3 AS revision FROM orders WHERE o_orderkey % 10 <> 9),
  d AS (SELECT o_orderkey AS document, (o_orderkey % 8) % 5 AS current_version, o_orderkey % 6 % 4 AS acknowledged, o_orderstatus = 'P' AS deleted, o_orderpriority = '1-URGENT' AS blocked, o_orderdate >= TIMESTAMP '2001-07-01' AS pending FROM orders)"""


@query(f"""WITH {EDGES}, {AUTHORISED} SELECT p.document, CASE WHEN (SELECT bool_or(pending) FROM d) THEN 'degraded' ELSE 'complete' END AS status,
  COALESCE(version = current_version AND revision = acknowledged AND NOT deleted AND NOT blocked, FALSE) AS allowed, COALESCE(n, 0) AS mentions FROM p LEFT JOIN d USING (document) LEFT JOIN (SELECT document, COUNT(*) AS n FROM edges GROUP BY 1) USING (document)""")
def ret16_authorised_mentions(t):
    """Which projected documents may be shown, with their mentions, and whether the graph is complete."""
    k = F.col("o_orderkey")
    projection = t.orders.where(k % 10 != 9).select(k.alias("document"), (k % 4).alias("version"), (k % 3).alias("revision"))
    held = t.orders.select(
        k.alias("document"), (k % 8 % 5).alias("current_version"), (k % 6 % 4).alias("acknowledged"), (F.col("o_orderstatus") == "P").alias("deleted"), (F.col("o_orderpriority") == "1-URGENT").alias("blocked"),
        (F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-07-01"))).alias("pending"),
    )
    counts = edges(t).groupBy("document").agg(F.count("*").alias("mentions"))
    return graph.authorised(projection, held).join(counts, "document", "left").select("document", "status", "allowed", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'create') THEN 'tool' WHEN length(text) - length(replace(text, ' ', '')) + 1 > 35 THEN 'complex' ELSE 'simple' END AS route FROM conversations""")
def ret21_router(t):
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return t.conversations.select("conv_id", "turn", F.when(F.instr(F.lower("text"), "create") > 0, "tool").when(words > 35, "complex").otherwise("simple").alias("route"))

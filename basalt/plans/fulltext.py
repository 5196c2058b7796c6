"""Full-text match, ranking, workspace search, evaluation arms and text-function queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import text as X
from basalt.operators import evaluation, fulltext, paging, text_index
from basalt.plans.registry import query
from basalt.tables import fresh_path, written

QUERY = "licensed under the apache"
WORDS = r"[w FOR w IN string_split_regex(lower({0}), '[^\pL\pN]+') IF w <> '']"


def ranked_sql(table: str, key: str, text: str, terms: list[str], where: str = "TRUE") -> str:
    """Cover density of terms in SQL: places of all words, the last place of each term up to each hit, one stretch for each start."""
    last = ", ".join(f"MAX(CASE WHEN w = '{t}' THEN p END) OVER (PARTITION BY k ORDER BY p) AS x{i}" for i, t in enumerate(terms))
    names = ", ".join(f"x{i}" for i in range(len(terms)))
    known = " AND ".join(f"x{i} IS NOT NULL" for i in range(len(terms)))
    return f"""(SELECT k, ROUND(SUM(1.0::DOUBLE / (e - s + 1)), 9) AS relevance FROM (SELECT k, s, MIN(p) AS e FROM (SELECT k, p, {'LEAST(' + names + ')' if len(terms) > 1 else 'x0'} AS s FROM (SELECT k, p, {last} FROM
      (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT {key} AS k, {WORDS.format(text)} AS ws FROM {table} WHERE {where})) WHERE w IN ({', '.join(repr(t) for t in terms)})) WHERE {known}) GROUP BY 1, 2) GROUP BY 1)"""


TERMS = fulltext.query_terms(QUERY)
FTS = ranked_sql("documents", "doc_id", "text", TERMS)
TOP = f"SELECT k AS doc_id, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, k) AS INTEGER) AS rank FROM {FTS} ORDER BY relevance DESC, k LIMIT 20"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({WORDS.format('text')}, {TERMS!r})")
def flt12_full_text_match(t):
    return t.documents.where(fulltext.holds_all(fulltext.words(F.col("text")), TERMS)).select("doc_id")


@query(TOP)
def ret04_full_text_rank(t):
    return fulltext.ranked(t.documents, "doc_id", "text", QUERY, 20)


@query(TOP)
def ret04_indexed_rank(t):
    """The same rows over an inverted index on disk: of the texts' words only the query's postings are read."""
    index = text_index.build(t.documents, "doc_id", "text", fresh_path(t.spark, "text-index"), stemmed=False, block_rows=256)
    return text_index.search(index, QUERY, 20, "doc_id")


#: Words of the given tables' alphabet that have the stems of `licenses apache under`.
STEMS = {"licens": ["license", "licenses", "licensed", "licensing"], "apach": ["apache", "apaches"], "under": ["under", "unders", "undered", "undering", "underly"]}
STEMMED = f"(SELECT doc_id, array_to_string([{' '.join(['CASE'] + [f'WHEN w IN ({str(ws)[1:-1]}) THEN {s!r}' for s, ws in STEMS.items()])} ELSE 'x' END FOR w IN {WORDS.format('text')}], ' ') AS stems FROM documents)"
STEMMED_TOP = f"SELECT k AS doc_id, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, k) AS INTEGER) AS rank FROM {ranked_sql(STEMMED, 'doc_id', 'stems', list(STEMS))} ORDER BY relevance DESC, k LIMIT 20"
INFLECTED = "licenses apache under"


@query(f"SELECT doc_id FROM {STEMMED} WHERE list_has_all(string_split(stems, ' '), {list(STEMS)!r})")
def flt12_stemmed_match(t):
    terms = fulltext.forms(written(fulltext.vocabulary(t.documents, "text"), "vocabulary"), INFLECTED)
    return t.documents.where(fulltext.holds_all_forms(fulltext.words(F.col("text")), terms)).select("doc_id")


@query(STEMMED_TOP)
def ret04_stemmed_rank(t):
    return fulltext.ranked(t.documents, "doc_id", "text", INFLECTED, 20, written(fulltext.vocabulary(t.documents, "text"), "vocabulary"))


@query(STEMMED_TOP)
def ret04_stemmed_index_rank(t):
    index = text_index.build(t.documents, "doc_id", "text", fresh_path(t.spark, "text-index"), block_rows=256)
    return text_index.search(index, INFLECTED, 20, "doc_id")


@query(f"""WITH r AS ({TOP}), l AS (SELECT doc_id, 1 AS part, 0 AS place FROM documents WHERE contains(lower(text), '{QUERY}') ORDER BY doc_id LIMIT 20),
  u AS (SELECT doc_id, 0 AS part, rank AS place FROM r UNION ALL SELECT * FROM l) SELECT doc_id, CAST(row_number() OVER (ORDER BY p, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, MIN({{'a': part, 'b': place}}) AS p FROM u GROUP BY 1)""")
def ret06_full_text_keyword(t):
    return fulltext.keyword_ranking(t.documents, "doc_id", "text", QUERY, 20)


@query(r"""SELECT p_partkey FROM part WHERE list_has_all([w FOR w IN string_split_regex(lower(p_name), '[^\pL\pN]+') IF w <> ''], ['r', 'ng']) OR lower(p_name) LIKE '%r_ng%' OR list_contains([p_brand, p_type], 'r_ng')""")
def flt15_title_search(t):
    return t.part.where(fulltext.title_match(F.col("p_name"), F.array("p_brand", "p_type"), "r_ng")).select("p_partkey")


NOTE = "que les"
NOTE_FTS = ranked_sql("(SELECT conv_id * 1000 + turn AS id, text FROM conversations)", "id", "text", ["que", "les"])


@query(f"""SELECT c.conv_id, c.turn, COALESCE(relevance, 0) AS relevance, left(c.text, 1500) AS content FROM conversations c LEFT JOIN {NOTE_FTS} f ON f.k = c.conv_id * 1000 + c.turn
  WHERE relevance IS NOT NULL OR contains(lower(c.text), '{NOTE}') ORDER BY COALESCE(relevance, 0) DESC, c.turn, c.conv_id LIMIT 20""")
def ret10_note_search(t):
    terms = fulltext.query_terms(NOTE)
    held = t.conversations.withColumn("w", fulltext.words(F.col("text")))
    hit = held.where(fulltext.holds_all(F.col("w"), terms) | (F.instr(F.lower("text"), NOTE) > 0))
    scored = hit.select("conv_id", "turn", F.round(fulltext.cover_rank(F.col("w"), terms), 9).alias("relevance"), F.substring("text", 1, 1500).alias("content"))
    return scored.orderBy(F.desc("relevance"), "turn", "conv_id").limit(20)


SEARCH = "apache license"
DOCS = ranked_sql("documents", "doc_id", "text", ["apache", "license"])
TITLES = ranked_sql("(SELECT doc_id, source || ' ' || lang || CASE WHEN doc_id % 50 = 0 THEN ' apache license' ELSE '' END AS title FROM documents)", "doc_id", "title", ["apache", "license"])
TALK = ranked_sql("conversations", "conv_id * 1000 + turn", "text", ["apache", "license"], "role = '{0}'")


@query(f"""WITH hits AS (SELECT 'documents' AS kind, d.doc_id AS id, ROUND(GREATEST(2 * COALESCE(t.relevance, 0), COALESCE(x.relevance, 0)), 9) AS rank FROM documents d LEFT JOIN {DOCS} x ON x.k = d.doc_id LEFT JOIN {TITLES} t ON t.k = d.doc_id WHERE t.k IS NOT NULL OR x.k IS NOT NULL
  UNION ALL SELECT 'tasks', p_partkey, 1.0::DOUBLE FROM part WHERE contains(lower(p_type), 'economy') AND p_size > 48 UNION ALL SELECT 'memories', k, relevance FROM {TALK.format('user')} UNION ALL SELECT 'chat', k, relevance FROM {TALK.format('assistant')}),
  placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank DESC, id) AS r, COUNT(*) OVER (PARTITION BY kind) AS matches FROM hits)
  SELECT kind, id, rank, matches, CAST(LEAST(matches, 10) AS BIGINT) AS returned, matches > 10 AS has_more FROM placed WHERE r <= 10""")
def ret11_four_scopes(t):
    terms = fulltext.query_terms(SEARCH)

    def rank(text):
        return fulltext.cover_rank(fulltext.words(text), terms)

    title = F.concat("source", F.lit(" "), "lang", F.when(F.col("doc_id") % 50 == 0, " apache license").otherwise(""))
    docs = t.documents.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.round(F.greatest(2 * rank(title), rank(F.col("text"))), 9).alias("rank"))
    tasks = t.part.where((F.instr(F.lower("p_type"), "economy") > 0) & (F.col("p_size") > 48)).select(F.lit("tasks").alias("kind"), F.col("p_partkey").alias("id"), F.lit(1.0).alias("rank"))
    kind = F.when(F.col("role") == "user", "memories").when(F.col("role") == "assistant", "chat")
    talk = t.conversations.select(kind.alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.round(rank(F.col("text")), 9).alias("rank")).where("kind IS NOT NULL")
    hits = paging.union_all(docs, tasks, talk).where("rank > 0")
    first = paging.latest(hits, ["kind"], [F.desc("rank"), F.asc("id")], 10)
    counts = hits.groupBy("kind").agg(F.count("*").alias("matches"))  # four rows
    return first.join(F.broadcast(counts), "kind").select("kind", "id", "rank", "matches", F.least("matches", F.lit(10)).cast("long").alias("returned"), (F.col("matches") > 10).alias("has_more"))


ARM_TERMS = "list_distinct([w FOR w IN string_split_regex(lower({0}), '[^\\pL\\pN]+') IF length(w) > 3 AND w NOT IN ({1})])".replace("{1}", ", ".join(repr(w) for w in fulltext.STOP))
ARM = f"""q AS (SELECT item_id AS query, {ARM_TERMS.format('text')} AS a FROM benchmark), d AS (SELECT doc_id AS item, {ARM_TERMS.format('text')} AS b FROM documents),
  s AS (SELECT query, item, ROUND(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 9) AS score FROM q, d WHERE list_has_any(a, b)),
  arm AS (SELECT * FROM (SELECT query, item, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS INTEGER) AS rank FROM s) WHERE rank <= 20)"""


def _terms(column):
    return F.array_distinct(F.filter(fulltext.words(column), lambda w: (F.length(w) > 3) & ~w.isin(*fulltext.STOP)))


def _arm(t):
    return fulltext.lexical_arm(t.benchmark.select(F.col("item_id").alias("query"), _terms(F.col("text")).alias("terms")), t.documents.select(F.col("doc_id").alias("item"), _terms(F.col("text")).alias("terms")), 20)


@query(f"WITH {ARM} SELECT * FROM arm")
def eval01_lexical_arm(t):
    return _arm(t)


@query(f"""WITH {ARM}, truth AS (SELECT item_id AS query, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)), w AS (SELECT query, COUNT(*) AS relevant FROM truth GROUP BY 1),
  h AS (SELECT query, COUNT(*) FILTER (WHERE rank <= 5) AS hit, MIN(rank) AS first, SUM(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE rank <= 5) AS dcg FROM arm SEMI JOIN truth USING (query, item) GROUP BY 1)
  SELECT query, ROUND(COALESCE(hit, 0) / relevant, 6) AS recall, ROUND(COALESCE(hit, 0) / 5, 6) AS precision, ROUND(COALESCE(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank,
  ROUND(COALESCE(dcg, 0) / list_sum([1.0::DOUBLE / log2(i + 1) FOR i IN range(1, 1 + LEAST(relevant, 5))]), 6) AS ndcg, COALESCE(hit, 0) = relevant AS complete FROM w LEFT JOIN h USING (query)""")
def eval02_lexical_metrics(t):
    quotes = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("quote"))
    met = fulltext.contained(t.documents.select(F.col("doc_id").alias("item"), "text"), quotes, "item").select("query", "item").distinct()
    return evaluation.metrics(_arm(t), met, 5)


@query("""WITH e AS (SELECT l_orderkey, l_partkey, l_extendedprice AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem),
  a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, r) AS r FROM e WHERE l_partkey % 5 <> 0),
  x AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS x FROM e WHERE r <= 3 GROUP BY 1), y AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS y FROM a WHERE r <= 3 GROUP BY 1)
  SELECT l_orderkey, ROUND(COALESCE(len(list_intersect(x, y)), 0) / len(x), 6) AS recall, COALESCE(len(y), 0) >= len(x) AS complete FROM x LEFT JOIN y USING (l_orderkey)""")
def eval04_recall_of_top_lists(t):
    order = [F.desc("l_extendedprice"), F.asc("l_linenumber")]
    exact = paging.latest(t.lineitem, ["l_orderkey"], order, 3)
    found = paging.latest(t.lineitem.where("l_partkey % 5 <> 0"), ["l_orderkey"], order, 3)
    return evaluation.top_list_recall(exact, found, "l_orderkey", "l_partkey")


COMPACT = r"trim(regexp_replace(text, '[\s\x0b\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT doc_id, {COMPACT} AS c FROM documents), p AS (SELECT *, CASE WHEN contains(lower(c), 'the and') THEN strpos(lower(c), 'the and') WHEN contains(lower(c), 'the') THEN strpos(lower(c), 'the') WHEN contains(lower(c), 'and') THEN strpos(lower(c), 'and') ELSE 1 END - 1 AS pos FROM c),
  s AS (SELECT *, GREATEST(0, LEAST(pos - 30, length(c) - 90)) AS s FROM p) SELECT doc_id, md5(CASE WHEN length(c) <= 90 THEN c ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substring(c, s + 1, 90)) || CASE WHEN s + 90 < length(c) THEN '…' ELSE '' END END) AS snippet FROM s""")
def fn02_search_snippet(t):
    return t.documents.select("doc_id", F.md5(X.snippet(F.col("text"), "the and", 90).cast("binary")).alias("snippet"))


@query(r"SELECT doc_id, array_to_string([x FOR x, i IN l IF list_position(l, x) = i], ',') AS years FROM (SELECT doc_id, [x FOR x IN regexp_extract_all(text, '[0-9-]+') IF regexp_full_match(x, '[12][0-9]{3}')] AS l FROM documents)")
def fn11_document_years(t):
    return t.documents.select("doc_id", F.array_join(X.years(F.col("text")), ",").alias("years"))


@query("SELECT doc_id, md5(left(text, CAST(list_max([i FOR i IN range(0, 101) IF strlen(left(text, i)) <= 100]) AS INTEGER))) AS cut FROM documents")
def fn23_cut_utf8(t):
    return t.documents.select("doc_id", F.md5(X.cut_utf8(F.col("text"), 100).cast("binary")).alias("cut"))


@query("SELECT c_custkey, COALESCE(n, 0) AS orders, COALESCE(total, 0.0::DOUBLE) AS total FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def fn30_fill(t):
    sums = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.join(sums, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query(f"""WITH c AS (SELECT doc_id, {COMPACT} AS c FROM documents), s AS (SELECT *, [x FOR x IN string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF x <> ''] AS p FROM c),
  b AS (SELECT *, [x FOR x IN [rtrim(left(y, 500)) FOR y IN (CASE WHEN len(p) = 1 THEN [trim(substring(c, i, 320)) FOR i IN range(1, 1 + GREATEST(1, LEAST(length(c), 700)), 320)] ELSE p END)[1:64]] IF x <> ''] AS b FROM s),
  k AS (SELECT *, LEAST(3, list_max([i FOR i IN range(1, 4) IF i = 1 OR list_sum([length(x) FOR x IN b[1:i]]) <= 700])) AS n FROM b)
  SELECT doc_id, md5(CASE WHEN c = '' THEN 'This document does not contain extractable text.' ELSE array_to_string(b[1:n], ' ') END) AS summary FROM k""")
def fn33_extractive_summary(t):
    return t.documents.select("doc_id", F.md5(X.extractive_summary(F.col("text"), "brief").cast("binary")).alias("summary"))


ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH a AS (SELECT page_id, {ESC.format('html')} AS body, replace(replace(replace({ESC.format('left(html, 60)')}, chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;') AS v FROM pages)
  SELECT page_id, md5('<evidence id="D' || page_id || '" title=' || CASE WHEN contains(v, '"') AND contains(v, '''') THEN '"' || replace(v, '"', '&quot;') || '"' WHEN contains(v, '"') THEN '''' || v || '''' ELSE '"' || v || '"' END || '>' || chr(10) || body || chr(10) || '</evidence>') AS rendered FROM a""")
def fn34_render_evidence(t):
    shown = F.concat(F.lit('<evidence id="D'), F.col("page_id").cast("string"), F.lit('" title='), X.quote_xml(F.substring("html", 1, 60)), F.lit(">\n"), X.escape_xml(F.col("html")), F.lit("\n</evidence>"))
    return t.pages.select("page_id", F.md5(shown.cast("binary")).alias("rendered"))


@query("""SELECT conv_id, COUNT(*) AS source_count, COUNT(*) FILTER (WHERE role = 'user') AS document, COUNT(*) FILTER (WHERE role = 'assistant') AS memory, COUNT(*) FILTER (WHERE role = 'system') AS tool, 'grounding:v1' AS profile FROM conversations GROUP BY 1""")
def prj03_trace_projection(t):
    kind = F.when(F.col("role") == "user", "document").when(F.col("role") == "assistant", "memory").otherwise("tool")
    traces = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct(kind.alias("kind"), "text")).alias("sources"))
    manifest = traces.select("conv_id", F.create_map(F.lit("profile"), F.lit("grounding:v1"), F.lit("secret"), F.lit("x")).alias("generation"), "sources")

    def of(kind):
        return F.size(F.filter("sources", lambda s: s["kind"] == kind)).cast("long").alias(kind)

    counts = [of(k) for k in ("document", "memory", "tool")]
    shown = F.map_filter("generation", lambda k, _: k.isin("profile", "model"))
    return manifest.select("conv_id", F.size("sources").cast("long").alias("source_count"), *counts, shown["profile"].alias("profile"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY 2 LIMIT 50")
def top07_priority_sort(t):
    status = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    order = [status, F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")]
    first = t.orders.orderBy(*order).limit(50)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("place"))  # 50 rows


@query("SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS INTEGER) AS bytes, base64(unhex(sha256(text))) AS hash64 FROM documents WHERE strlen(text) <= 50000000")
def src07_bounded_hash(t):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return t.documents.where(F.octet_length("text") <= 50_000_000).select("doc_id", digest.alias("hash"), F.octet_length("text").alias("bytes"), F.base64(F.unhex(digest)).alias("hash64"))

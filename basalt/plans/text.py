"""Parsing, chunking, text-function, entity, window and workspace-search queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import chunking, vectors
from basalt.functions import text as X
from basalt.operators import entities, fulltext, paging, retrieval
from basalt.plans.registry import query
from basalt.sources import parsers
from basalt.streaming import outbox


GAP = r"[\s\x0b\x{85}\p{Z}\x1c-\x1f]"


def chunks_sql(source: str, target: int, overlap: int) -> str:
    """CTEs up to `chunks` (g, i, a, b, words): the chunks of each text of source (g, text) with spans in it: sentences, long ones as runs of words, and a recursion that goes from chunk to chunk over their sums."""
    run = int((target - overlap) / 1.3)
    word = f"[^{GAP[1:-1]}]+"
    lead = f"length(p) - length(regexp_replace(p, '^{GAP}+', ''))"
    tail = f"length(regexp_replace(p, '{GAP}+$', ''))"
    return f"""src AS ({source}),
  pieces AS (SELECT g, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT g, string_split(regexp_replace(text, '([.!?])({GAP}+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM src)),
  placed AS (SELECT g, i, p, CAST(SUM(length(p)) OVER (PARTITION BY g ORDER BY i) AS BIGINT) - length(p) AS pos, len(regexp_extract_all(p, '{word}')) AS w FROM pieces),
  sentences AS (SELECT g, i, 0 AS j, pos + {lead} AS a, pos + {tail} AS b, w FROM placed WHERE w > 0 AND GREATEST(1, floor(w * 1.3::DOUBLE)) <= {target}),
  parts AS (SELECT g, i, pos, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM (SELECT g, i, pos, regexp_extract_all(p, '{word}|{GAP}+') AS xs FROM placed WHERE GREATEST(1, floor(w * 1.3::DOUBLE)) > {target})),
  spans AS (SELECT g, i, k, x, pos + CAST(SUM(length(x)) OVER (PARTITION BY g, i ORDER BY k) AS BIGINT) - length(x) AS a FROM parts),
  numbered AS (SELECT g, i, a, a + length(x) AS b, row_number() OVER (PARTITION BY g, i ORDER BY k) - 1 AS n FROM spans WHERE regexp_full_match(x, '{word}')),
  units AS (SELECT g, i, j, a, b, w FROM sentences UNION ALL SELECT g, i, n // {run}, MIN(a), MAX(b), COUNT(*) FROM numbered GROUP BY 1, 2, 3),
  lists AS (SELECT g, list(a ORDER BY i, j) AS sa, list(b ORDER BY i, j) AS sb, list(w ORDER BY i, j) AS ws, list_concat([0], list(t ORDER BY i, j)) AS sums, COUNT(*) AS n
    FROM (SELECT *, CAST(SUM(GREATEST(1, floor(w * 1.3::DOUBLE))) OVER (PARTITION BY g ORDER BY i, j) AS BIGINT) AS t FROM units) GROUP BY 1),
  steps(g, i, f, l) AS (SELECT g, 0, CAST(0 AS BIGINT), CAST(GREATEST(1, len([s FOR s IN sums IF s <= {target}]) - 1) AS BIGINT) FROM lists
    UNION ALL SELECT g, i + 1, f2, CAST(GREATEST(l + 1, len([s FOR s IN sums IF s <= sums[f2 + 1] + {target}]) - 1) AS BIGINT) FROM (SELECT s.g, s.i, s.l, x.sums,
      CAST(LEAST(l, GREATEST(f, len([s FOR s IN sums IF s < sums[l + 1] - {overlap}]), len([s FOR s IN sums IF s < sums[l + 2] - {target}]))) AS BIGINT) AS f2 FROM steps s JOIN lists x USING (g) WHERE l < n)),
  chunks AS (SELECT g, i, sa[f + 1] AS a, sb[l] AS b, list_sum(ws[f + 1 : l]) AS words FROM steps JOIN lists USING (g))"""


CHUNK_ROW = "CAST({0} AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_char, CAST(b AS INTEGER) AS end_char, CAST(GREATEST(1, floor(words * 1.3::DOUBLE)) AS INTEGER) AS token_count"


@query(f"WITH RECURSIVE {chunks_sql('SELECT doc_id AS g, text FROM documents', 400, 50)} SELECT g AS doc_id, {CHUNK_ROW.format('i')} FROM chunks")
def ing01_token_chunks(t):
    return chunking.chunk(t.documents, "doc_id", "text", "token").drop("content")


@query(f"WITH RECURSIVE {chunks_sql('SELECT doc_id AS g, text FROM documents', 450, 40)} SELECT g AS doc_id, {CHUNK_ROW.format('i')} FROM chunks")
def ing02_sentence_chunks(t):
    return chunking.chunk(t.documents, "doc_id", "text", "semantic").drop("content")


#: Paragraphs with their place in the text: between empty lines, without the white space around them.
PARAGRAPHS = f"""SELECT g, text FROM (SELECT {{'d': doc_id, 'i': i, 'pos': pos + length(p) - length(regexp_replace(p, '^{GAP}+', ''))}} AS g, regexp_replace(regexp_replace(p, '^{GAP}+', ''), '{GAP}+$', '') AS text FROM (SELECT doc_id, i, replace(p, chr(2), '') AS p, CAST(SUM(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(p) AS pos
  FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(\n[ \t]*\n+)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM documents)))) WHERE text <> ''"""


@query(f"""WITH RECURSIVE {chunks_sql(PARAGRAPHS, 400, 50)}, whole AS (SELECT g, len(regexp_extract_all(text, '[^{GAP[1:-1]}]+')) AS words, length(text) AS n FROM src),
  chosen AS (SELECT g, 0 AS i, 0 AS a, n AS b, words FROM whole WHERE GREATEST(1, floor(words * 1.3::DOUBLE)) <= 400 UNION ALL SELECT c.g, c.i, c.a, c.b, c.words FROM chunks c JOIN whole w ON w.g = c.g WHERE GREATEST(1, floor(w.words * 1.3::DOUBLE)) > 400)
  SELECT g.d AS doc_id, CAST(row_number() OVER (PARTITION BY g.d ORDER BY g.i, i) - 1 AS INTEGER) AS chunk_index, CAST(g.pos + a AS INTEGER) AS start_char, CAST(g.pos + b AS INTEGER) AS end_char, CAST(GREATEST(1, floor(words * 1.3::DOUBLE)) AS INTEGER) AS token_count FROM chosen""")
def ing03_recursive_chunks(t):
    return chunking.chunk(t.documents, "doc_id", "text", "recursive").drop("content")


#: Markdown made of the documents: a preamble for some, a heading for the source, and one before every second sentence end.
MARKDOWN = "CASE WHEN doc_id % 3 = 0 THEN 'About' || chr(10) ELSE '' END || '# ' || source || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10) || '## Part ' || lang || chr(10) || '  ')"
SECTIONS = f"""md AS (SELECT doc_id, {MARKDOWN} AS text FROM documents),
  heads AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i, len(ps) AS n FROM (SELECT doc_id, [x FOR x IN string_split(regexp_replace(text, '(?m)^(#{{1,6}}[ \t]+[^\n]+)$', chr(1) || '\\1' || chr(2), 'g'), chr(1))] AS ps FROM md)),
  cut AS (SELECT doc_id, i, n, string_split(p, chr(2)) AS hb, CAST(SUM(length(replace(p, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(replace(p, chr(2), '')) AS pos FROM heads),
  bodies AS (SELECT doc_id, i, CASE WHEN len(hb) = 2 THEN trim(regexp_extract(hb[1], '^#+[ \t]+(.*)$', 1)) ELSE 'Preamble' END AS title, hb[-1] AS body, pos + CASE WHEN len(hb) = 2 THEN length(hb[1]) ELSE 0 END AS pos FROM cut),
  sections AS (SELECT doc_id, title, i, CAST(pos + length(body) - length(regexp_replace(body, '^{GAP}+', '')) AS INTEGER) AS start_char, CAST(pos + length(regexp_replace(body, '{GAP}+$', '')) AS INTEGER) AS end_char FROM bodies WHERE regexp_replace(body, '{GAP}+', '') <> '')"""


def _markdown(t):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "About\n").otherwise(""), F.lit("# "), "source", F.lit("\n"), F.replace(F.col("text"), F.lit(". "), F.concat(F.lit(".\n\n## Part "), "lang", F.lit("\n  "))))
    return t.documents.select("doc_id", "lang", text.alias("text"))


@query(f"""WITH RECURSIVE {SECTIONS}, {chunks_sql("SELECT {'d': doc_id, 'i': s.i, 'pos': start_char, 'title': title} AS g, substring(text, start_char + 1, end_char - start_char) AS text FROM sections s JOIN md USING (doc_id)", 400, 50)}
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g.i, c.i) - 1 AS INTEGER) AS chunk_index, CAST(g.pos + a AS INTEGER) AS start_char, CAST(g.pos + b AS INTEGER) AS end_char, g.title AS section,
    md5('D' || doc_id || ' > ' || g.title || ': ' || substring(text, g.pos + a + 1, b - a)) AS contextualized FROM chunks c JOIN md ON md.doc_id = g.d""")
def ing06_section_chunks(t):
    """Sections of every document chunked each by themselves, with spans in the whole text."""
    md = _markdown(t)
    sections = parsers.markdown_sections(md, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "title", "page", "start_char", "end_char"))).alias("sections"))
    docs = md.join(sections, "doc_id").withColumn("name", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
    made = chunking.section_chunks(docs, "doc_id", "text", "sections", "name")
    return made.select("doc_id", "chunk_index", "start_char", "end_char", "section", F.md5(F.col("contextualized").cast("binary")).alias("contextualized"))


@query("SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index FROM documents WHERE FALSE")
def ing07_span_violations(t):
    chunks = chunking.chunk(t.documents, "doc_id", "text", "token")
    return chunking.span_violations(chunks, t.documents, "doc_id", "text").select("doc_id", "chunk_index")


@query("SELECT doc_id, TRUE AS unit, CAST(1536 AS INTEGER) AS size FROM documents")
def ing12_fn20_embedding_norm(t):
    made = vectors.with_lexical_embedding(t.documents.select("doc_id", "text"), "text", "v")
    return made.select("doc_id", (F.abs(retrieval.norm(F.col("v")) - 1) < 1e-3).alias("unit"), F.size("v").alias("size"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'binary content' WHEN doc_id % 5 = 1 THEN 'not UTF-8' WHEN doc_id % 5 = 2 THEN 'no text' END AS error, CASE WHEN doc_id % 5 > 2 THEN 'Document Content' END AS title, CASE WHEN doc_id % 5 > 2 THEN CAST(length(text) AS INTEGER) END AS end_char FROM documents""")
def src01_text_sections(t):
    """Files of every kind of fault among the documents' texts, and the section of each sound one."""
    k = F.col("doc_id") % 5
    body = F.when(k == 0, F.concat(F.col("text").cast("binary"), F.lit(bytes([0])))).when(k == 1, F.concat(F.col("text").cast("binary"), F.lit(bytes([0xC3, 0x28])))).when(k == 2, F.lit(b" \n\t ")).otherwise(F.col("text").cast("binary"))
    read = parsers.text_files(t.documents.select("doc_id", body.alias("content")), "doc_id", "content")
    return read.select("doc_id", "error").join(parsers.text_sections(read, "doc_id"), "doc_id", "left").select("doc_id", "error", "title", "end_char")


@query(f"WITH {SECTIONS} SELECT doc_id, title, start_char, end_char FROM sections")
def src02_markdown_sections(t):
    return parsers.markdown_sections(_markdown(t), "doc_id").select("doc_id", "title", "start_char", "end_char")


@query(r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x0b\x{85}\p{Z}\x1c-\x1f]+', ' ', 'g'))) AS folded FROM documents")
def fn04_fold(t):
    return t.documents.select("doc_id", F.md5(vectors.fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT event_id, sha256('{\"k\":' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || '}') AS canonical FROM events")
def fn22_canonical_hash(t):
    return t.events.select("event_id", vectors.canonical_hash(F.col("props")).alias("canonical"))


@query()
def fn35_name_uuid(t):
    return t.events.select("event_id", vectors.name_uuid(F.concat_ws(":", "event_type", "event_id")).alias("id"))


@query()
def snk04_signature(t):
    return t.events.select("event_id", vectors.signature(F.col("props"), F.unix_timestamp(F.col("ts").cast("timestamp")), "test-only").alias("signature"))


@query("SELECT event_id, CAST(CASE WHEN user_id % 2 = 0 THEN '{\"k\":' || json_extract_string(props, '$.k') || ',\"api_key\":\"[REDACTED]\",\"total_tokens\":7}' ELSE '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS VARCHAR) AS safe FROM events")
def flt20_redact(t):
    body = F.when(F.col("user_id") % 2 == 0, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "api_key": "x", "total_tokens": 7}'))).otherwise(F.col("props"))
    return t.events.select("event_id", vectors.redact(body).alias("safe"))


@query()
def fn02_snippet(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), "the and", 90).alias("snippet"))


@query()
def fn11_years(t):
    return t.documents.select("doc_id", F.array_join(X.years(F.col("text")), ",").alias("years"))


@query("""WITH r AS (SELECT event_id, ts, user_id % 4 AS k, CAST((event_id * 7) % 500 + 1 AS INTEGER) AS n FROM events), d AS (SELECT event_id, ts, CASE k WHEN 0 THEN ts + to_minutes(n) WHEN 1 THEN ts + to_hours(n) WHEN 2 THEN ts + to_days(n) ELSE ts - to_minutes(n) END AS due FROM r)
  SELECT event_id, CASE WHEN due BETWEEN ts - INTERVAL 1 SECOND AND ts + INTERVAL 366 DAY THEN due END AS due, CASE WHEN due < ts - INTERVAL 1 SECOND THEN 'past' WHEN due > ts + INTERVAL 366 DAY THEN 'too far' END AS error FROM d""")
def fn25_str17_reminder_time(t):
    """Reminders said relative to now, or as a time, that are due, past or too far ahead."""
    n, k = (F.col("event_id") * 7 % 500 + 1).cast("string"), F.col("user_id") % 4
    unit = F.when(k == 0, " minutes").when(k == 1, " hour").otherwise("  Days ")
    stated = F.concat(F.date_format(F.expr("ts - make_dt_interval(0, 0, cast(event_id * 7 % 500 + 1 as int))"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    said = t.events.select("event_id", "ts", F.when(k == 3, stated).otherwise(F.concat(F.lit("in "), n, unit)).alias("said"))
    return said.select("event_id", X.reminder(F.col("said"), F.col("ts")).alias("r")).select("event_id", "r.due", "r.error")


@query("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT conv_id, list_sort(list_distinct(list(lower(trim(' ' || role || ' '))))) AS list_distinct_ordered FROM conversations GROUP BY 1)")
def fn29_tags(t):
    g = t.conversations.groupBy("conv_id").agg(F.collect_list(F.concat(F.lit(" "), F.upper("role"), F.lit(" "))).alias("r"))
    return g.select("conv_id", F.array_join(F.array_sort(X.tags(F.col("r"))), ",").alias("tags"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) || ', ' || lower(p_brand) || '!' AS title FROM part")
def fn31_title_form(t):
    """All titles, those with runs of blanks too."""
    return t.part.select("p_partkey", X.title_form(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("  ,  "), "p_brand", F.lit(" !"))).alias("title"))


@query("SELECT source, 'local' AS provider, source AS model, CAST(1536 AS INTEGER) AS size FROM documents GROUP BY 1")
def fn36_embedding_profile(t):
    p = F.split("profile", ":")
    named = t.documents.select("source").distinct().withColumn("profile", F.concat(F.lit("embedding-space:v1:local:"), "source", F.lit(":1536")))
    return named.where(F.col("profile").rlike(r"^embedding-space:v1:[a-z0-9_-]+:[A-Za-z0-9._-]+:\d+$")).select("source", p[2].alias("provider"), p[3].alias("model"), p[4].cast("int").alias("size"))


@query("SELECT event_id, ts - INTERVAL 2 HOUR AS source_time FROM events WHERE user_id % 2 = 0")
def fn38_source_time(t):
    stated = t.events.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("user_id") % 2 == 0, "+02:00").otherwise("")).alias("s"))
    zoned = stated.where(F.col("s").rlike(r"(Z|[+-]\d{2}:\d{2})$"))
    return zoned.select("event_id", F.try_to_timestamp("s").cast("timestamp_ntz").alias("source_time"))


@query("SELECT n_regionkey, CAST(i AS INTEGER) AS ordinal, name FROM (SELECT n_regionkey, unnest(list(n_name ORDER BY n_nationkey)) AS name, unnest(range(1, COUNT(*) + 1)) AS i FROM nation GROUP BY 1)")
def fn39_json_elements(t):
    packed = t.nation.groupBy("n_regionkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])).alias("j"))
    return packed.select("n_regionkey", F.posexplode(F.from_json("j", "array<string>")).alias("p", "name")).select("n_regionkey", (F.col("p") + 1).alias("ordinal"), "name")


@query("SELECT vec_id, ROUND(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 5) AS norm FROM embeddings")
def fn19_norm(t):
    return t.embeddings.select("vec_id", F.round(retrieval.norm(F.col("embedding")), 5).alias("norm"))


NAME = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}{2,}){0,3})"


@query(rf"""SELECT doc_id, name, n FROM (SELECT doc_id, name, COUNT(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY COUNT(*) DESC, name) AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{NAME}', 1)) AS name FROM documents) WHERE name NOT IN ('The', 'And', 'For', 'This', 'That') GROUP BY 1, 2) WHERE r <= 250""")
def ret18_entities(t):
    found = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("name"))
    counts = found.where(~F.col("name").isin("The", "And", "For", "This", "That")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    return paging.latest(counts, ["doc_id"], [F.desc("n"), F.asc("name")], 250)


DICTIONARY = ("apache", "license", "licensed under", "the and", "van", "und")
PADDED = r"string_split(regexp_replace(lower(text), '[^\pL\pN_ ]', ' | ', 'g'), ' ')"


@query(f"""WITH d AS (SELECT doc_id, {PADDED} AS w FROM documents), terms AS (SELECT unnest({list(DICTIONARY)!r}) AS term),
  one AS (SELECT doc_id, x AS term FROM (SELECT doc_id, unnest(w) AS x FROM d) WHERE x IN (SELECT term FROM terms)), two AS (SELECT doc_id, x AS term FROM (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w)) IF w[i] <> '' AND w[i + 1] <> '']) AS x FROM d) WHERE x IN (SELECT term FROM terms))
  SELECT doc_id, CASE WHEN length(term) <= 4 THEN upper(term) ELSE array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(term, ' ')], ' ') END AS name, COUNT(*) AS mentions FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY doc_id, term""")
def ret18_dictionary(t):
    """Whole-word hits of a dictionary in all texts, found by one automaton."""
    terms = t.spark.createDataFrame([(x,) for x in DICTIONARY], "term string")
    return entities.dictionary_hits(t.documents, "doc_id", "text", terms).select("doc_id", entities.canonical(F.col("term")).alias("name"), "mentions")


TOKENS = "[w FOR w IN regexp_extract_all(lower(text), '[a-z0-9_-]{2,}') IF length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'that')]"


@query(f"""WITH k AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(list_distinct(list_concat(list_concat(
  [struct_pack(n := -1, s := x) FOR x IN w], [struct_pack(n := -2, s := w[i] || ' ' || w[i + 1]) FOR i IN range(1, len(w))]), [struct_pack(n := -3, s := w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) FOR i IN range(1, len(w) - 1)]))) AS x FROM k)
  SELECT conv_id, turn, x.s AS entity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY x.n, x.s) AS r FROM g) WHERE r <= 30""")
def ret13_query_entities(t):
    stop = ["the", "and", "for", "that"]
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]{2,}"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    held = t.conversations.select("conv_id", "turn", words.alias("w"))

    def grams(n):
        places = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        made = F.transform(places, lambda i: F.struct(F.lit(-n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("s")))
        return F.when(F.size("w") >= n, made).otherwise(F.expr("array()").cast("array<struct<n: int, s: string>>"))

    first = F.slice(F.array_sort(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))), 1, 30)
    return held.select("conv_id", "turn", F.explode(first).alias("x")).select("conv_id", "turn", F.col("x.s").alias("entity"))


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return outbox.tumbling(rows, "1 hour", "10 minutes", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT CAST(time_bucket(INTERVAL '30 minutes', ts) - INTERVAL 30 MINUTE * o AS TIMESTAMP) AS start, COUNT(*) AS n FROM events, (VALUES (0), (1)) x(o) GROUP BY 1")
def stream_sliding(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return outbox.sliding(rows, "1 hour", "30 minutes").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return outbox.sessions(rows, "6 hours", "user_id").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


HITS = """hits AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS title, CAST(2 AS DOUBLE) AS rank FROM part WHERE contains(lower(p_name || ' ' || p_type), 'e') AND p_size > 45
  UNION ALL SELECT 'customer', c_custkey, c_name, 1 FROM customer WHERE contains(lower(c_mktsegment), 'e') AND c_acctbal > 9000)"""


@query(f"""WITH {HITS} SELECT kind, id, title, rank, matches, matches > 10 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank DESC, id) AS r, COUNT(*) OVER (PARTITION BY kind) AS matches FROM hits) WHERE r <= 10""")
def ret11_workspace_search(t):
    parts = t.part.where((F.instr(F.lower(F.concat_ws(" ", "p_name", "p_type")), "e") > 0) & (F.col("p_size") > 45)).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(2.0).alias("rank"))
    people = t.customer.where((F.instr(F.lower("c_mktsegment"), "e") > 0) & (F.col("c_acctbal") > 9000)).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(1.0).alias("rank"))
    hits = paging.union_all(parts, people)
    first = paging.latest(hits, ["kind"], [F.desc("rank"), F.asc("id")], 10)
    return first.join(F.broadcast(hits.groupBy("kind").agg(F.count("*").alias("matches"))), "kind").withColumn("has_more", F.col("matches") > 10)  # two kinds


HYBRID = "licensed under the apache license"


@query()
def ret08_hybrid_search(t):
    """Both rankings are of documents: cosine of lexical embeddings, and full text with the literal phrase after it."""
    asked = vectors.with_lexical_embedding(t.spark.range(1).select(F.lit(HYBRID).alias("text")), "text", "q").select("q")  # one row
    near = vectors.with_lexical_embedding(t.documents.select("doc_id", "text"), "text", "v").crossJoin(F.broadcast(asked))
    first = near.select("doc_id", F.round(1 - retrieval.cosine(F.col("v"), F.col("q")), 9).alias("distance")).orderBy("distance", "doc_id").limit(20)
    semantic = first.select("doc_id", F.row_number().over(Window.orderBy("distance", "doc_id")).alias("rank"))  # 20 rows
    return fulltext.hybrid(semantic, fulltext.keyword_ranking(t.documents, "doc_id", "text", HYBRID, 20), "doc_id", 20)

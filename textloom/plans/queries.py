"""Queries over the driver's tables, one for each operator or group of them, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import aggregates, answers, bm25, budget, chunking, designs, evidence, failures, plots, report, runs, statistics, validation, vfs
from textloom.plans import base
from textloom.plans.base import ASKED, CALLS, FACTS, FILES, NEEDED, RUNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The patterns of ``functions.text`` as DuckDB reads them.
TERM = r"[\p{L}\p{N}]+(?:[\x27-][\p{L}\p{N}]+)*"
TOKEN = TERM + r"|[^\p{L}\p{N}_\s]"


def norm_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def terms_sql(x: str) -> str:
    return f"regexp_extract_all({norm_sql(x)}, '{TERM}')"


def tokens_sql(x: str) -> str:
    return f"len(regexp_extract_all({norm_sql(x)}, '{TOKEN}'))"


# Text


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_term FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents) x")
def text_terms(spark, d):
    t = base.files(spark, d).select("doc_id", T.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_term"))


@query(f"SELECT doc_id, CAST({tokens_sql('text')} AS BIGINT) AS n_tokens FROM documents")
def text_tokens(spark, d):
    return base.files(spark, d).select("doc_id", T.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


LINES = "(SELECT doc_id, source, unnest(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS line, generate_subscripts(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END, 1) AS no FROM documents)"


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(length(line)) AS BIGINT) AS longest FROM {LINES} x GROUP BY doc_id")
def text_lines(spark, d):
    x = base.files(spark, d).select("doc_id", F.explode(T.lines(F.col("text"))).alias("line"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@query(f"SELECT item_id, regexp_replace(trim(regexp_replace({norm_sql('text')}, '\\s+', ' ', 'g')), '[.?!]+$', '') AS answer FROM benchmark")
def normal_answers(spark, d):
    return base.base(spark, d, "SELECT item_id, text FROM benchmark", "benchmark").select("item_id", T.normal_answer(F.col("text")).alias("answer"))


@query("SELECT o_orderkey, substr(sha256('42:task:' || CAST(o_orderkey AS VARCHAR)), 1, 16) AS seed_hex, CASE WHEN instr('13579bdf', substr(sha256('42:' || CAST(o_orderkey AS VARCHAR)), 64, 1)) > 0 THEN 'vfs' ELSE 'snippets' END AS first_condition FROM orders")
def seeds_and_orders(spark, d):
    o = base.base(spark, d, "SELECT o_orderkey FROM orders", "orders")
    hexed = F.lpad(F.lower(F.conv(T.child_seed(F.lit(42), F.lit("task"), F.col("o_orderkey")).cast("string"), 10, 16)), 16, "0")
    first = F.when(designs.vfs_first(42, F.col("o_orderkey").cast("string")), "vfs").otherwise("snippets")
    return o.select("o_orderkey", hexed.alias("seed_hex"), first.alias("first_condition"))


@query("SELECT conv_id, CAST(2 + sum(4 + " + tokens_sql("'{\"content\":' || to_json(text) || ',\"role\":' || to_json(role) || ',\"tool_call_id\":null,\"tool_calls\":null}'") + ") AS BIGINT) AS request_tokens FROM conversations GROUP BY conv_id")
def request_tokens(spark, d):
    m = base.base(spark, d, "SELECT conv_id, role, text FROM conversations", "conversations").groupBy("conv_id").agg(F.collect_list(T.canonical_message(F.col("role"), F.col("text"))).alias("m"))
    return m.select("conv_id", T.count_messages(F.col("m")).alias("request_tokens"))


@query()
def truncated_texts(spark, d):
    x = base.files(spark, d).select("doc_id", T.truncate_to_tokens(F.col("text"), F.lit(50)).alias("head"))
    return x.select("doc_id", "head", T.count_tokens(F.col("head"), exact=True).cast("long").alias("n_tokens"))


CHUNK_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, no, CAST({tokens_sql('line')} AS BIGINT) AS c FROM {LINES} x),
p AS (SELECT doc_id, no, c, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
q AS (SELECT a.doc_id, a.no, a.c, a.n, a.upto - a.c AS before, min(CASE WHEN b.upto - (a.upto - a.c) >= 180 THEN b.no END) AS full_at, min(CASE WHEN b.upto - (a.upto - a.c) >= 180 THEN b.upto END) AS full_sum FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.no >= a.no GROUP BY ALL),
e AS (SELECT doc_id, no, c, n, before, CASE WHEN c > 180 THEN no + 1 WHEN full_at IS NULL THEN n + 1 WHEN full_sum - before = 180 THEN full_at + 1 ELSE greatest(full_at, no + 1) END AS stop FROM q),
f AS (SELECT e.doc_id, e.no, e.c, e.stop, z.upto - e.before AS held, z.upto AS at_stop, e.before FROM e JOIN p z ON z.doc_id = e.doc_id AND z.no = e.stop - 1),
g AS (SELECT f.doc_id, f.no, f.c, f.stop, f.held, max(CASE WHEN f.at_stop - (b.upto - b.c) >= 30 THEN b.no END) AS back FROM f JOIN p b ON b.doc_id = f.doc_id AND b.no >= f.no AND b.no < f.stop GROUP BY ALL),
s AS (SELECT doc_id, no, c, stop, held, CASE WHEN c > 180 THEN stop WHEN held <= 30 THEN stop WHEN back IS NOT NULL AND back > no THEN back ELSE stop END AS next FROM g),
o AS (SELECT doc_id, no, c, stop, held, next FROM s WHERE no = 1 UNION ALL SELECT s.doc_id, s.no, s.c, s.stop, s.held, s.next FROM o JOIN s ON s.doc_id = o.doc_id AND s.no = o.next),
w AS (SELECT doc_id, no, stop - 1 AS last, held AS tokens, 0 AS piece FROM o WHERE c <= 180 AND held > 0 UNION ALL SELECT doc_id, no, no, least(180, c - piece * 150), piece FROM (SELECT doc_id, no, c, unnest(range(0, CAST(ceil((c - 30) / 150.0) AS BIGINT))) AS piece FROM o WHERE c > 180) y)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, last, piece) - 1 AS INT) AS chunk_index, CAST(no AS INT) AS start_line, CAST(last AS INT) AS end_line, CAST(tokens AS BIGINT) AS token_count FROM w"""


@query(CHUNK_SQL)
def chunks(spark, d):
    return chunking.chunk_documents(base.files(spark, d)).select("doc_id", "chunk_index", "start_line", "end_line", "token_count")


# Retrieval

BM25 = f"""words AS (SELECT c.chunk_id, c.doc_id, c.path, unnest({terms_sql('c.text')}) AS term FROM c), lens AS (SELECT c.chunk_id, c.doc_id, c.path, CAST(len({terms_sql('c.text')}) AS BIGINT) AS length FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL), tot AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lens), raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, tot GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms_sql('query')}) AS term FROM asked) z GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, doc_id, path, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 9) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN lens USING (chunk_id), tot GROUP BY ALL)"""
DOC_CHUNKS = f"asked AS ({ASKED}), c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, path, text FROM ({FILES}) f)"
LINE_CHUNKS = f"asked AS ({ASKED}), c AS (SELECT CAST(doc_id AS VARCHAR) || '::c' || lpad(CAST(no - 1 AS VARCHAR), 4, '0') AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, line AS text FROM {LINES} x)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score >= 0{0})"


def _documents(spark, d) -> DataFrame:
    return base.files(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "path", "text")


def _lines(spark, d) -> DataFrame:
    x = base.files(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "path", F.posexplode(T.lines(F.col("text"))).alias("at", "text"))
    return x.select(F.concat("doc_id", F.lit("::c"), F.lpad(F.col("at").cast("string"), 4, "0")).alias("chunk_id"), "doc_id", "path", "text")


@query(f"WITH {DOC_CHUNKS}, {BM25} SELECT (SELECT CAST(n AS BIGINT) FROM tot) AS n_chunks, round((SELECT mean_length FROM tot), 6) AS mean_length, (SELECT CAST(count(*) AS BIGINT) FROM tf) AS n_postings, (SELECT CAST(count(*) AS BIGINT) FROM idf) AS n_terms")
def bm25_statistics(spark, d):
    index = bm25.build_index(_documents(spark, d))
    one = index.totals.select(F.col("n").alias("n_chunks"), F.round("mean_length", 6).alias("mean_length"))
    return one.crossJoin(index.postings.agg(F.sum("n").alias("n_postings"))).crossJoin(index.idf.agg(F.count(F.lit(1)).alias("n_terms")))  # one row each


@query(f"WITH {DOC_CHUNKS}, {BM25}, {RANKED.format('')} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, path, round(score, 6) AS score FROM ranked WHERE rank <= 8")
def bm25_topk(spark, d):
    hits = bm25.search(bm25.build_index(_documents(spark, d)), base.asked(spark, d), 8, pad=False)
    return hits.select("query_id", "rank", "chunk_id", "path", F.round("score", 6).alias("score"))


@query()
def bm25_padded_topk(spark, d):
    """As ``bm25_topk``; a query with few hits is filled up with chunks of score 0."""
    return bm25.search(bm25.build_index(_documents(spark, d)), base.asked(spark, d), 8).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {DOC_CHUNKS}, {BM25}, {RANKED.format(" AND (starts_with(path, '/src1/') OR path = '/src2/2.md')")} SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_path_filter(spark, d):
    return bm25.search(bm25.build_index(_documents(spark, d)), base.asked(spark, d), 5, ["/src1/", "/src2/2.md"], pad=False).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


ROLLED = "rolled AS (SELECT query_id, doc_id, max(score) AS best_score, CAST(count(*) AS BIGINT) AS n_chunks, arg_min(chunk_id, rank) AS best_chunk_id FROM ranked WHERE rank <= 8 GROUP BY query_id, doc_id)"


@query(f"WITH {LINE_CHUNKS}, {BM25}, {RANKED.format('')}, {ROLLED} SELECT query_id, doc_id, round(best_score, 6) AS best_score, n_chunks, best_chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, doc_id) AS INT) AS rank FROM rolled")
def bm25_document_rollup(spark, d):
    hits = bm25.search(bm25.build_index(_lines(spark, d)), base.asked(spark, d), 8, pad=False)
    return bm25.document_hits(hits).select("query_id", "doc_id", F.round("best_score", 6).alias("best_score"), F.size("chunk_ids").cast("long").alias("n_chunks"), "best_chunk_id", "rank")


GOLD = "gold AS (SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {DOC_CHUNKS}, {BM25}, {RANKED.format('')}, {GOLD} SELECT g.query_id, CAST(count(*) AS BIGINT) AS n_gold, CAST(count(r.doc_id) AS BIGINT) AS n_found, count(r.doc_id) / count(*) AS recall FROM gold g LEFT JOIN (SELECT query_id, doc_id FROM ranked WHERE rank <= 8) r USING (query_id, doc_id) GROUP BY g.query_id")
def retrieval_recall(spark, d):
    q = base.asked(spark, d)
    gold = validation.leaks(q.select(F.col("query_id").alias("task_id"), F.col("query").alias("question")), _documents(spark, d).select("doc_id", F.col("text").alias("content"))).withColumnRenamed("task_id", "query_id")
    return bm25.retrieval_recall(bm25.search(bm25.build_index(_documents(spark, d)), q, 8, pad=False), gold, 8)


@query("SELECT b.item_id AS task_id, CAST(d.doc_id AS VARCHAR) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def question_leaks(spark, d):
    q = base.asked(spark, d).select(F.col("query_id").alias("task_id"), F.col("query").alias("question"))
    return validation.leaks(q, _documents(spark, d).select("doc_id", F.col("text").alias("content")))


@query()
def snippet_packing(spark, d):
    own = _documents(spark, d)
    hits = bm25.search(bm25.build_index(own), base.asked(spark, d), 8, pad=False).join(own.select("chunk_id", "text"), "chunk_id").join(base.asked(spark, d).withColumnRenamed("query", "question"), "query_id")
    return budget.pack_snippets(hits.withColumns({"start_line": F.lit(1), "end_line": F.size(T.lines(F.col("text")))}))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id AS query_id, turn AS chunk, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, {tokens_sql('text')} AS n FROM conversations),
f AS (SELECT query_id, r, CASE WHEN n <= 300 THEN n ELSE 0 END AS held, CASE WHEN n <= 300 THEN 1 ELSE 0 END AS taken FROM t WHERE r = 1 UNION ALL
SELECT t.query_id, t.r, f.held + CASE WHEN f.held + t.n <= 300 THEN t.n ELSE 0 END, f.taken + CASE WHEN f.held + t.n <= 300 THEN 1 ELSE 0 END FROM f JOIN t ON t.query_id = f.query_id AND t.r = f.r + 1)
SELECT query_id, CAST(arg_max(taken, r) AS INT) AS n_taken FROM f GROUP BY query_id""")
def packed_turns(spark, d):
    t = base.base(spark, d, "SELECT conv_id, turn, text FROM conversations", "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("turn").cast("string").alias("chunk_id"), T.count_tokens(F.col("text")).alias("tokens"))
    return budget.packed_by_tokens(t, 300).select("query_id", F.size("taken").alias("n_taken"))


# Files


@query(f"SELECT path, doc_id AS request_id, CAST(2 AS INT) AS start_line, CAST(CASE WHEN n >= 2 THEN least(4, n) END AS INT) AS end_line, CASE WHEN n >= 2 THEN array_to_string(l[2:4], chr(10)) END AS content, CASE WHEN n < 2 THEN 'RANGE_INVALID' END AS error_code FROM (SELECT doc_id, path, l, len(l) AS n FROM (SELECT doc_id, path, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM ({FILES}) f) g) h")
def vfs_read(spark, d):
    docs = base.files(spark, d)
    asked = docs.select(F.col("doc_id").alias("request_id"), "path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return vfs.read_ranges(docs, asked)


@query(f"SELECT doc_id AS request_id, path, CASE WHEN n <= 768 THEN text END AS content, CASE WHEN n <= 768 THEN n END AS token_count, CASE WHEN n > 768 THEN 'PER_CALL_LIMIT' END AS error_code FROM (SELECT *, CAST({tokens_sql('text')} AS BIGINT) AS n FROM ({FILES}) f) g")
def vfs_cat(spark, d):
    docs = base.files(spark, d)
    out = vfs.cat_files(docs, docs.select(F.col("doc_id").alias("request_id"), "path"))
    return out.withColumn("token_count", F.col("token_count").cast("long"))


@query(f"SELECT 'root' AS request_id, category || '/' AS entry FROM ({FILES}) f GROUP BY category UNION ALL SELECT 'src3', CAST(doc_id AS VARCHAR) || '.md' FROM documents WHERE source = 'src3'")
def vfs_list(spark, d):
    asked = spark.createDataFrame([("root", None), ("src3", "/src3/")], "request_id string, path string")
    return vfs.list_directory(vfs.build_tree(base.files(spark, d)), asked)


GREPPED = f"""WITH l AS (SELECT doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(no AS INT) AS no, line, count(*) OVER (PARTITION BY doc_id) AS n FROM {LINES} x),
m AS (SELECT doc_id, path, greatest(1, no - 1) AS a, CAST(least(n, no + 1) AS INT) AS b, min(no) AS first_no FROM l WHERE list_has_any({terms_sql('line')}, ['license', 'ouer']) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, first_no, path, a) AS ordinal FROM m) SELECT 1 AS query_id, CAST(ordinal AS INT) AS ordinal, r.path, CAST(a AS INT) AS start_line, b AS end_line, string_agg(line, chr(10) ORDER BY no) AS preview FROM r JOIN l ON l.doc_id = r.doc_id AND no BETWEEN a AND b WHERE ordinal <= 50 GROUP BY ALL"""


@query(GREPPED)
def vfs_grep(spark, d):
    docs = base.files(spark, d)
    whole = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "path", F.lit(1).alias("start_line"), "text")
    ranked = docs.select(F.lit(1).alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"))
    asked = spark.createDataFrame([(1, "License ouer", 50)], "query_id int, query string, max_results int")
    return vfs.grep(vfs.build_lines(docs, whole), ranked, asked)


@query("SELECT url, CASE WHEN contains(url, '://') THEN 'INVALID_PATH' END AS error_code FROM pages")
def vfs_paths(spark, d):
    return base.base(spark, d, "SELECT url FROM pages", "pages").select("url", vfs.path_error(F.col("url")).alias("error_code"))


# Evidence

SHOWN = "shown AS (SELECT * FROM calls WHERE ok AND tool IN ('grep', 'read', 'cat'))"
EXPOSED = f"calls AS ({CALLS}), facts AS ({FACTS}), {SHOWN}, exposed AS (SELECT DISTINCT run_id, call_ordinal, fact_id FROM shown s JOIN facts f ON s.path = f.path AND f.line_start <= s.end_line AND f.line_end >= s.start_line)"


def _shown(spark, d) -> DataFrame:
    ranges = F.array(F.struct("path", "start_line", "end_line"))
    return evidence.content_ranges(base.calls(spark, d).withColumn("line_ranges", ranges))


@query(f"""WITH calls AS ({CALLS}), {SHOWN}, m AS (SELECT *, max(end_line) OVER (PARTITION BY run_id, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM shown),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT run_id, path, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY run_id, path, island""")
def merged_ranges(spark, d):
    return evidence.merge_ranges(_shown(spark, d).select("run_id", "path", "start_line", "end_line"), ["run_id", "path"])


@query(f"WITH {EXPOSED} SELECT run_id, call_ordinal, fact_id FROM exposed")
def exposed_facts(spark, d):
    return evidence.exposed_facts(_shown(spark, d), base.facts(spark, d))


@query(f"WITH {EXPOSED}, need AS ({NEEDED}), f AS (SELECT run_id, fact_id, min(call_ordinal) AS first FROM exposed GROUP BY ALL) SELECT run_id, CASE WHEN count(first) = count(*) THEN max(first) END AS ordinal FROM need LEFT JOIN f USING (run_id, fact_id) GROUP BY run_id")
def coverage_ordinal(spark, d):
    return evidence.coverage_ordinal(evidence.exposed_facts(_shown(spark, d), base.facts(spark, d)), base.needed(spark, d))


@query(f"WITH {EXPOSED}, need AS ({NEEDED}), g AS (SELECT run_id, min(call_ordinal) AS call_ordinal FROM exposed JOIN need USING (run_id, fact_id) GROUP BY run_id), s AS (SELECT run_id, call_ordinal, 5.0 + sum(latency_ms) OVER (PARTITION BY run_id ORDER BY call_ordinal) AS ms FROM calls) SELECT run_id, CAST(ms AS DOUBLE) AS time_ms FROM s JOIN g USING (run_id, call_ordinal)")
def first_gold_time(spark, d):
    exposed = evidence.exposed_facts(_shown(spark, d), base.facts(spark, d))
    return evidence.first_gold_time(base.calls(spark, d).withColumn("retrieval_ms", F.lit(5.0)), exposed, base.needed(spark, d))


COUNTED = ", ".join(f"CAST(count(*) FILTER (WHERE tool = '{t}') AS BIGINT) AS {t}_calls" for t in vfs.TOOLS)


@query(f"WITH calls AS ({CALLS}), t AS (SELECT *, row_number() OVER (PARTITION BY run_id, request_key ORDER BY call_ordinal) > 1 AS again FROM calls) SELECT run_id, CAST(count(*) AS BIGINT) AS tool_call_count, {COUNTED}, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS successful_tool_calls, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS invalid_tool_calls, CAST(count(*) FILTER (WHERE again) AS BIGINT) AS repeated_tool_calls FROM t GROUP BY run_id")
def tool_counters(spark, d):
    return evidence.tool_counters(base.calls(spark, d))


@query(f"WITH {EXPOSED}, need AS ({NEEDED}), a AS (SELECT DISTINCT run_id, fact_id FROM exposed), x AS (SELECT run_id, count(*) AS n, count(a.run_id) AS gold FROM need LEFT JOIN a USING (run_id, fact_id) GROUP BY run_id), y AS (SELECT run_id, count(*) AS shown FROM a GROUP BY run_id) SELECT run_id, gold / n AS recall, CASE WHEN coalesce(shown, 0) = 0 THEN 0.0 ELSE gold / shown END AS precision, CAST(gold AS INT) AS distinct_gold_facts, gold = n AS all_required_accessed FROM x LEFT JOIN y USING (run_id)")
def evidence_metrics(spark, d):
    shown = evidence.exposed_facts(_shown(spark, d), base.facts(spark, d)).groupBy("run_id").agg(F.collect_set("fact_id").alias("shown"))
    need = base.needed(spark, d).groupBy("run_id").agg(F.collect_set("fact_id").alias("need"))
    m = evidence.evidence_metrics(F.coalesce("shown", F.array().cast("array<string>")), F.col("need"))
    return need.join(shown, "run_id", "left").select("run_id", m.alias("m")).select("run_id", "m.*")


# Answers


@query()
def parsed_answers(spark, d):
    made = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.lit("doc-a-0001"), F.lit("doc-a-0001")).alias("citations"), F.when(F.col("item_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(300))).otherwise("short").alias("justification")))
    x = base.base(spark, d, "SELECT item_id, text FROM benchmark", "benchmark").select("item_id", answers.parse_answer(made).alias("p"), answers.response_is_valid(made).alias("ends_run"))
    return x.select("item_id", "p.answer", F.size("p.citations").alias("n_citations"), "ends_run")


@query("""SELECT c_custkey, CASE WHEN n = 0 THEN 0.0 ELSE (gd + gc) / n END AS precision, CASE WHEN gd + gc > 0 THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN gd = 1 THEN 1.0 ELSE 0.0 END AS document_precision, CASE WHEN gc = 1 THEN 1.0 ELSE 0.0 END AS chunk_precision
FROM (SELECT c_custkey, 2 AS n, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS gd, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS gc FROM customer) x""")
def citation_scores(spark, d):
    c = base.base(spark, d, "SELECT c_custkey FROM customer", "customer")
    doc = F.concat(F.lit("doc-"), (F.col("c_custkey") % 2).cast("string"))
    chunk = F.concat(F.lit("doc-0::c"), (F.col("c_custkey") % 3).cast("string"))
    s = answers.citation_score(F.array(doc, chunk, doc), F.array(F.lit("doc-0")), F.array(F.lit("doc-0::c0")))
    return c.select("c_custkey", s.alias("s")).select("c_custkey", "s.precision", "s.recall", "s.document_precision", "s.chunk_precision")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS matched FROM nation")
def matched_answers(spark, d):
    n = base.base(spark, d, "SELECT n_nationkey, n_name FROM nation", "nation")
    said = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ?!"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lower("n_name"), F.lit("."))).otherwise(F.concat("n_name", F.lit(" x")))
    said = F.regexp_replace(said, r" \?!$", "?!")
    return n.select("n_nationkey", answers.matched_variant(said, F.lit("none of them"), F.array("n_name")).alias("matched"))


# Designs and budgets

CELLS_SQL = "(SELECT 'primary' AS design_cell, 8 AS n, false AS oracle_mode UNION ALL SELECT 'max_calls_0', 0, false UNION ALL SELECT 'max_calls_4', 4, false UNION ALL SELECT 'oracle', 8, true)"
DESIGN_SQL = f"""SELECT 'exp:' || task_id || ':' || condition || ':' || design_cell AS run_key, 'exp' AS experiment_id, task_id, design_cell, condition, CAST(CASE WHEN turned THEN 1 - o ELSE o END AS INT) AS condition_order, CAST(CASE WHEN condition = 'vfs' THEN n END AS INT) AS max_tool_calls, oracle_mode
FROM (SELECT 'task-eval-' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS task_id, instr('13579bdf', substr(sha256('42:task-eval-' || lpad(CAST(item_id AS VARCHAR), 6, '0')), 64, 1)) > 0 AS turned FROM benchmark) t CROSS JOIN {CELLS_SQL} c CROSS JOIN (SELECT 'snippets' AS condition, 0 AS o UNION ALL SELECT 'vfs', 1) k"""


def _design(spark, d) -> DataFrame:
    tasks = base.base(spark, d, "SELECT 'task-eval-' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS task_id FROM benchmark", "benchmark")
    return designs.expand_design(tasks, "exp", 42, (0, 4), oracle=True)


@query(DESIGN_SQL)
def expanded_design(spark, d):
    return _design(spark, d)


@query(f"SELECT run_key FROM ({DESIGN_SQL}) x WHERE NOT (condition = 'vfs' AND design_cell = 'primary')")
def pending_runs(spark, d):
    done = _design(spark, d).filter("condition = 'vfs' and design_cell = 'primary'")
    return designs.pending(_design(spark, d), done).select("run_key")


@query(f"""WITH t AS (SELECT conv_id AS run_id, turn, CAST(CASE WHEN role = 'user' THEN {tokens_sql('text')} ELSE 0 END AS BIGINT) AS i, CAST(CASE WHEN role = 'user' THEN 0 ELSE {tokens_sql('text')} END AS BIGINT) AS o FROM conversations)
SELECT run_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(CASE WHEN count(*) FILTER (WHERE turn % 4 = 3) = 0 THEN sum(i) + count(*) END AS BIGINT) AS provider_input, CAST(sum(i + o) AS BIGINT) AS total_tokens, CAST(4096 - sum(i + o) AS BIGINT) AS remaining,
CAST(CASE WHEN count(*) FILTER (WHERE turn % 4 = 3) = 0 THEN count(*) ELSE 0 END AS BIGINT) AS input_delta FROM t GROUP BY run_id""")
def token_accounting(spark, d):
    return budget.token_accounting(_turns(spark, d), 4096).select("run_id", "n_turns", "input_tokens", "output_tokens", "provider_input", "total_tokens", "remaining", "input_delta")


def _turns(spark, d) -> DataFrame:
    n = T.count_tokens(F.col("text")).cast("long")
    t = base.base(spark, d, "SELECT conv_id AS run_id, turn, role, text FROM conversations", "conversations")
    t = t.select("run_id", "turn", F.when(F.col("role") == "user", n).otherwise(F.lit(0)).alias("input_tokens"), F.when(F.col("role") == "user", F.lit(0)).otherwise(n).alias("output_tokens"))
    return t.withColumns({"provider_input": F.when(F.col("turn") % 4 != 3, F.col("input_tokens") + 1), "provider_output": F.lit(None).cast("long")})


@query(f"SELECT conv_id AS run_id, turn, CAST(4096 - sum({tokens_sql('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS remaining_after_turn FROM conversations")
def remaining_budget(spark, d):
    return budget.remaining_after(_turns(spark, d), 4096).select("run_id", "turn", "remaining_after_turn")


@query(f"SELECT run_key, CAST(least(256, greatest(0, token_limit - input_tokens)) AS BIGINT) AS cap, (input_tokens * 2.0 + output_tokens * 8.0) / 1000000.0 AS cost FROM ({RUNS}) r")
def admission_and_cost(spark, d):
    r = base.flat_runs(spark, d)
    return r.select("run_key", budget.admitted_cap(F.lit(256).cast("long"), F.col("input_tokens"), F.col("token_limit")).alias("cap"), budget.estimated_cost(F.col("input_tokens"), F.col("output_tokens"), 2.0, 8.0).alias("cost"))


# Summaries

#: The flat columns of the run frame that the summaries read, in terms of the runs' SQL.
FLAT = f"""(SELECT run_key, task_id, 'eval' AS split, condition, design_cell, success, recall AS initial_chunk_recall, recall AS initial_document_recall, recall AS initial_recall, 0 AS initial_retrieved_document_count, 0 AS initial_retrieved_chunk_count, 8 AS retrieval_k, final_recall AS final_evidence_recall, final_recall, precision AS evidence_precision,
gold_facts AS distinct_gold_facts, 0 AS accessed_fact_count, 0 AS accessed_document_count, 0 AS accessed_chunk_count, 0 AS accessed_line_range_count, all_required AS all_required_accessed, cite_precision AS citation_precision, cite_recall AS citation_recall, calls AS tool_call_count, coalesce(permitted, CAST(nullif(regexp_extract(design_cell, '^max_calls_([0-9]+)$', 1), '') AS INT)) AS max_tool_calls_permitted, calls - least(invalid, calls) AS successful_tool_calls,
invalid AS invalid_tool_calls, repeated AS repeated_tool_calls, calls AS grep_calls, 0 AS read_calls, 0 AS cat_calls, 0 AS list_calls, 0 AS unique_files_read_count, 0 AS unique_line_ranges_accessed_count, CAST(NULL AS DOUBLE) AS time_to_first_gold_fact_ms, CAST(NULL AS INT) AS calls_to_complete_gold_coverage, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, token_limit,
wall_ms, model_ms, retrieval_ms, tool_ms, cost AS estimated_cost_usd, hops AS hop_count, category, distractors AS distractor_count, CASE WHEN (input_tokens + output_tokens) / token_limit <= 0.25 THEN '0-25%' WHEN (input_tokens + output_tokens) / token_limit <= 0.5 THEN '25-50%' WHEN (input_tokens + output_tokens) / token_limit <= 0.75 THEN '50-75%' WHEN (input_tokens + output_tokens) / token_limit <= 1 THEN '75-100%' ELSE 'over-100%' END AS budget_bucket FROM ({RUNS}) r)"""


def _sql_metrics() -> str:
    mean = lambda names: [f"avg({c}) AS {c}_mean" for c in names]
    total = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
    won = "count(*) FILTER (WHERE success)"
    return ", ".join([
        "CAST(count(*) AS BIGINT) AS n", f"CAST({won} AS BIGINT) AS successes", f"{won} / count(*) AS success_rate", *mean(aggregates.BEFORE_CALLS), "avg(CAST(all_required_accessed AS INT)) AS all_required_accessed_rate", *mean(aggregates.CITED),
        f"{total('tool_call_count')} AS actual_tool_calls", f"{total('tool_call_count')} / count(*) AS actual_tool_calls_mean", *mean(aggregates.AFTER_CALLS), f"{total('total_tokens')} AS total_tokens", f"{total('total_tokens')} / count(*) AS total_tokens_mean", f"{total('input_tokens')} AS input_tokens", f"{total('output_tokens')} AS output_tokens",
        *mean(aggregates.TIMES), "coalesce(sum(estimated_cost_usd), 0) AS total_cost_usd", "coalesce(sum(estimated_cost_usd), 0) / count(*) AS mean_cost_usd", f"{won} * 1000 / nullif({total('total_tokens')}, 0) AS success_per_1000_tokens", "'ok' AS status",
    ])


M = _sql_metrics()


def _frame(spark, d) -> DataFrame:
    return runs.run_frame(base.nested_runs(spark, d))


_NOTHING = ("final_answer", "question", "parsed_answer", "parsed_answer_json", "parsed_answer_text", "parsed_answer_justification", "initial_retrieved_documents_json", "initial_retrieved_chunks_json", "accessed_evidence_json", "tool_trace_json", "errors_json")
#: The frame's columns that ``FLAT`` has not.
BESIDE = {
    "experiment_id": "'exp'", "condition_order": "CAST(NULL AS INT)", "corpus_version": "'v1'", "correctness": "f.success", "citations": "'[]'", "citations_json": "'[]'", "termination_reason": "r.termination", "gold_fact_count": "2", "gold_document_count": "1", "gold_chunk_count": "1",
    "calls": "f.tool_call_count", "permitted_tool_calls": "f.max_tool_calls_permitted", "tokens": "f.total_tokens", "hops": "f.hop_count", "task_category": "f.category", "distractors": "f.distractor_count", "token_budget_bucket": "f.budget_bucket",
    "gold_evidence_json": """'{"fact_ids":["fact-000001","fact-000002"],"doc_ids":["doc-a-0001"],"chunk_ids":["doc-a-0001::c0000"]}'""", "token_turns_json": "'[]'", "status": "'ok'", **dict.fromkeys(_NOTHING, "CAST(NULL AS VARCHAR)"),
}


@query(f"SELECT f.*, {', '.join(f'{v} AS {k}' for k, v in BESIDE.items())} FROM {FLAT} f JOIN ({RUNS}) r USING (run_key)")
def run_frame(spark, d):
    return _frame(spark, d)


@query(f"SELECT condition, design_cell, {M} FROM {FLAT} f GROUP BY condition, design_cell")
def condition_summary(spark, d):
    return aggregates.condition_summary(_frame(spark, d))


@query(f"SELECT 'hop_count' AS subgroup, CAST(hop_count AS VARCHAR) AS level, condition, design_cell, {M} FROM {FLAT} f GROUP BY hop_count, condition, design_cell UNION ALL SELECT 'category', category, condition, design_cell, {M} FROM {FLAT} f GROUP BY category, condition, design_cell")
def subgroup_summary(spark, d):
    return aggregates.subgroup_summary(_frame(spark, d))


@query(f"SELECT condition, max_tool_calls_permitted AS permitted_call_limit, design_cell, {M} FROM {FLAT} f WHERE condition = 'vfs' AND starts_with(design_cell, 'max_calls_') GROUP BY ALL")
def intervention_summary(spark, d):
    return aggregates.intervention_summary(_frame(spark, d))


@query(f"SELECT condition, budget_bucket, {M} FROM {FLAT} f GROUP BY condition, budget_bucket")
def efficiency_summary(spark, d):
    return aggregates.efficiency_summary(_frame(spark, d))


PAIRS = f"pairs AS (SELECT s.task_id, s.success AS s, v.success AS v, s.total_tokens AS st, v.total_tokens AS vt, s.initial_recall AS sr, v.initial_recall AS vr, s.hop_count AS h, s.category AS c FROM {FLAT} s JOIN {FLAT} v ON s.task_id = v.task_id AND s.design_cell = 'primary' AND v.design_cell = 'primary' AND s.condition = 'snippets' AND v.condition = 'vfs')"
OUTCOME = "CASE WHEN s AND v THEN 'both_succeed' WHEN s THEN 'snippets_only' WHEN v THEN 'vfs_only' ELSE 'both_fail' END"
#: Sums of powers of two often end in a five where they are rounded; this sets both sides beside it.
OFF_TIES = 3e-10
MCNEMAR = "round(CASE WHEN {b} + {c} = 0 OR {b} = {c} THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2))))) END + 3e-10, 7)"


@query(f"WITH {PAIRS} SELECT o.outcome, CAST(count(p.task_id) AS BIGINT) AS count, (SELECT CAST(count(*) AS BIGINT) FROM pairs) AS n, count(p.task_id) / (SELECT count(*) FROM pairs) AS rate FROM (SELECT unnest(['both_succeed', 'snippets_only', 'vfs_only', 'both_fail']) AS outcome) o LEFT JOIN (SELECT *, {OUTCOME} AS outcome FROM pairs) p USING (outcome) GROUP BY o.outcome")
def paired_counts(spark, d):
    return aggregates.paired_counts(_frame(spark, d))


@query(f"WITH {PAIRS}, k AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE s) AS BIGINT) AS snippets_successes, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS vfs_successes, CAST(count(*) FILTER (WHERE s AND NOT v) AS BIGINT) AS snippets_only, CAST(count(*) FILTER (WHERE v AND NOT s) AS BIGINT) AS vfs_only FROM pairs) SELECT n, snippets_successes, vfs_successes, snippets_only, vfs_only, snippets_successes / n AS snippets_success_rate, vfs_successes / n AS vfs_success_rate, (vfs_successes - snippets_successes) / n AS difference, {MCNEMAR.format(b='snippets_only', c='vfs_only')} AS mcnemar_p_value FROM k")
def paired_rates(spark, d):
    p = statistics.paired_rates(aggregates.paired(_frame(spark, d)).select("s_success", "v_success"))
    return p.withColumn("mcnemar_p_value", F.round(F.col("mcnemar_p_value") + OFF_TIES, 7))


PAIRED_STATE = f"(SELECT CASE WHEN max(greatest(s, v)) > 1 THEN 'duplicate_primary_record' WHEN min(least(s, v)) = 0 THEN 'incomplete_pairs' ELSE 'ok' END FROM (SELECT task_id, count(*) FILTER (WHERE condition = 'snippets') AS s, count(*) FILTER (WHERE condition = 'vfs') AS v FROM {FLAT} f WHERE design_cell = 'primary' GROUP BY task_id) x)"


@query(f"""WITH {PAIRS}, k AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE s) AS BIGINT) AS snippets_successes, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS vfs_successes, CAST(count(*) FILTER (WHERE s AND NOT v) AS BIGINT) AS snippets_only, CAST(count(*) FILTER (WHERE v AND NOT s) AS BIGINT) AS vfs_only FROM pairs)
SELECT outcome, CAST(c AS BIGINT) AS count, n, c / n AS rate, snippets_successes, vfs_successes, snippets_only, vfs_only, snippets_successes / n AS snippets_success_rate, vfs_successes / n AS vfs_success_rate, (vfs_successes - snippets_successes) / n AS difference, {MCNEMAR.format(b='snippets_only', c='vfs_only')} AS mcnemar_p_value, {PAIRED_STATE} AS status
FROM (SELECT o.outcome, count(p.task_id) AS c FROM (SELECT unnest(['both_succeed', 'snippets_only', 'vfs_only', 'both_fail']) AS outcome) o LEFT JOIN (SELECT *, {OUTCOME} AS outcome FROM pairs) p USING (outcome) GROUP BY o.outcome) x CROSS JOIN k""")
def paired_outcomes(spark, d):
    """All but the bootstrap's interval, which ``paired_interval`` has."""
    p = aggregates.paired_outcomes(_frame(spark, d)).drop("ci_lower", "ci_upper")
    return p.withColumn("mcnemar_p_value", F.round(F.col("mcnemar_p_value") + OFF_TIES, 7))


@query()
def paired_interval(spark, d):
    """The interval by drawn rows and by drawn counts."""
    by_rows = statistics.paired_summary(_frame(spark, d)).select(F.lit("rows").alias("drawn"), "n", "difference", "ci_lower", "ci_upper")
    return by_rows.unionByName(statistics.paired_summary(_frame(spark, d), by_index=False).select(F.lit("counts").alias("drawn"), "n", "difference", "ci_lower", "ci_upper"))


@query(f"SELECT l_orderkey, CAST(max(l_linenumber) AS INT) AS b, CAST(min(l_suppkey) % 40 AS INT) AS c, {MCNEMAR.format(b='max(l_linenumber)', c='(min(l_suppkey) % 40)')} AS p_value FROM lineitem GROUP BY l_orderkey")
def exact_mcnemar(spark, d):
    x = base.base(spark, d, "SELECT l_orderkey, CAST(max(l_linenumber) AS INT) AS b, CAST(min(l_suppkey) % 40 AS INT) AS c FROM lineitem GROUP BY l_orderkey", "lineitem")
    return x.withColumn("p_value", F.round(statistics.exact_mcnemar(F.col("b"), F.col("c")) + OFF_TIES, 7))


@query(f"SELECT design_cell, task_id, max(CASE WHEN condition = 'snippets' THEN success END) AS snippets_success, max(CASE WHEN condition = 'vfs' THEN success END) AS vfs_success, max(CASE WHEN condition = 'vfs' THEN total_tokens END) AS vfs_total_tokens, max(hop_count) AS hop_count, CASE WHEN count(DISTINCT condition) = 2 THEN 'ok' ELSE 'incomplete_pair' END AS status FROM {FLAT} f GROUP BY design_cell, task_id")
def task_level(spark, d):
    return aggregates.task_level(_frame(spark, d)).select("design_cell", "task_id", "snippets_success", "vfs_success", "vfs_total_tokens", "hop_count", "status")


BAND = "CASE WHEN {0} = 0 THEN '0' WHEN {0} = 1 THEN '1' ELSE '(0,1)' END"
STRATA = f"""WITH {PAIRS}, t AS (SELECT unnest([st, vt]) AS t FROM pairs), e AS (SELECT list_sort(list_distinct([quantile_cont(t, 0), quantile_cont(t, 0.25), quantile_cont(t, 0.5), quantile_cont(t, 0.75), quantile_cont(t, 1)])) AS e FROM t),
q AS (SELECT p.*, 'q' || (1 + len(list_filter(e[2:-2], lambda x: x <= st))) AS sq, 'q' || (1 + len(list_filter(e[2:-2], lambda x: x <= vt))) AS vq, {BAND.format('sr')} AS sb, {BAND.format('vr')} AS vb FROM pairs p, e),
x AS (SELECT s, v, 'token_quartile' AS stratum, sq AS a, vq AS b FROM q UNION ALL SELECT s, v, 'recall_band', sb, vb FROM q UNION ALL SELECT s, v, 'hop', CAST(h AS VARCHAR), CAST(h AS VARCHAR) FROM q UNION ALL SELECT s, v, 'category', c, c FROM q),
lv AS (SELECT 'token_quartile' AS stratum, 'q' || i AS band FROM (SELECT unnest(range(1, greatest(2, len(e)))) AS i FROM e) z UNION SELECT 'recall_band', unnest(['0', '(0,1)', '1']) UNION SELECT stratum, a FROM x WHERE stratum IN ('hop', 'category')),
g AS (SELECT stratum, a AS band, count(*) AS n, count(*) FILTER (WHERE s) AS ss, count(*) FILTER (WHERE v) AS vs, count(*) FILTER (WHERE s AND NOT v) AS so, count(*) FILTER (WHERE v AND NOT s) AS vo FROM x WHERE a = b GROUP BY stratum, a)
SELECT lv.stratum, lv.band, CAST(coalesce(n, 0) AS BIGINT) AS n, ss / n AS snippets_success_rate, vs / n AS vfs_success_rate, (vs - ss) / n AS difference, CASE WHEN n IS NOT NULL THEN {MCNEMAR.format(b='so', c='vo')} END AS mcnemar_p_value, CASE WHEN n IS NULL THEN 'no within-band pairs' END AS missing_reason FROM lv LEFT JOIN g ON lv.stratum = g.stratum AND lv.band = g.band"""


@query(STRATA)
def stratified_summary(spark, d):
    return statistics.stratified(_frame(spark, d)).withColumn("mcnemar_p_value", F.round(F.col("mcnemar_p_value") + OFF_TIES, 7))


SHARES = (0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


@query(f"SELECT share, quantile FROM (SELECT unnest([{', '.join(map(str, SHARES))}]) AS share, unnest([{', '.join(f'quantile_cont(l_extendedprice, {x})' for x in SHARES)}]) AS quantile FROM lineitem) x")
def exact_quantiles(spark, d):
    """Quantiles of a column of many different values, by selection over the partitions."""
    found = statistics.exact_quantiles(base.base(spark, d, "SELECT l_extendedprice FROM lineitem", "lineitem"), "l_extendedprice", SHARES)
    return spark.createDataFrame(list(zip(SHARES, found or [None] * len(SHARES), strict=True)), "share double, quantile double")


@query()
def vfs_regression(spark, d):
    return statistics.within_vfs_regression(_frame(spark, d))


LABELS = {
    "initial_retrieval_miss": "recall = 0", "failed_exploration": "condition = 'vfs' AND calls > 0 AND gold_facts = 0", "incomplete_evidence_coverage": "final_recall < 1", "incorrect_evidence_composition": "NOT success AND all_required AND cite_precision < 1",
    "unsupported_answer": "NOT success AND cite_precision < 1", "correct_evidence_wrong_conclusion": "NOT success AND all_required AND cite_precision >= 1", "budget_exhaustion": "termination = 'budget_exhausted'", "excessive_repeated_tool_use": "calls > 0 AND (repeated >= 3 OR repeated / calls >= 0.5)",
    "invalid_tool_call": "invalid > 0", "malformed_final_answer": "NOT parsed",
}
LABELLED = f"SELECT condition, design_cell, unnest(list_filter([{', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, w in LABELS.items())}], lambda x: x IS NOT NULL)) AS failure_class FROM ({RUNS}) r"


@query(f"WITH l AS ({LABELLED}), n AS (SELECT condition, design_cell, count(*) AS n FROM ({RUNS}) r GROUP BY ALL) SELECT condition, design_cell, failure_class, CAST(count(*) AS BIGINT) AS count, CAST(any_value(n) AS BIGINT) AS n, count(*) / any_value(n) AS rate, 'ok' AS status FROM l JOIN n USING (condition, design_cell) GROUP BY condition, design_cell, failure_class")
def failure_summary(spark, d):
    return aggregates.failure_summary(base.nested_runs(spark, d))


@query()
def trace_examples(spark, d):
    return failures.trace_examples(base.nested_runs(spark, d))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_runs, CAST(count(DISTINCT task_id) AS BIGINT) AS n_tasks, array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions, array_to_string(list_sort(list(DISTINCT design_cell)), ',') AS design_cells, 'none' AS mock_state FROM ({RUNS}) r")
def report_run_set(spark, d):
    return report.run_set(base.nested_runs(spark, d)).select("n_runs", "n_tasks", F.array_join("conditions", ",").alias("conditions"), F.array_join("design_cells", ",").alias("design_cells"), "mock_state")


@query(f"SELECT category, CAST(count(*) AS BIGINT) AS n FROM {FLAT} f WHERE design_cell = 'primary' AND NOT success GROUP BY category ORDER BY n DESC, category LIMIT 1")
def report_hardest_category(spark, d):
    return report.hardest_category(_frame(spark, d))


POINTS = {
    "figure_by_hop": (plots.by_hop, "hop_count", "design_cell = 'primary'"),
    "figure_by_actual_calls": (plots.by_actual_calls, "tool_call_count", "design_cell = 'primary' AND condition = 'vfs'"),
    "figure_by_permitted_calls": (plots.by_permitted_calls, "max_tool_calls_permitted", "starts_with(design_cell, 'max_calls_') AND condition = 'vfs'"),
    "figure_by_initial_recall": (plots.by_initial_recall, "initial_recall", "design_cell = 'primary'"),
    "figure_by_evidence_recall": (plots.by_evidence_recall, "final_recall", "design_cell = 'primary'"),
    "figure_by_tokens": (plots.by_tokens, "floor(total_tokens / 256) * 256", "design_cell = 'primary'"),
}
for _name, (_f, _x, _where) in POINTS.items():
    QUERIES[_name] = lambda spark, d, f=_f: f(_frame(spark, d))
    SQL[_name] = f"SELECT CAST({_x} AS DOUBLE) AS x, condition, CAST(count(*) AS BIGINT) AS n, avg(CAST(success AS INT)) AS success_rate FROM {FLAT} f WHERE {_where} AND {_x} IS NOT NULL GROUP BY ALL"


@query(f"WITH {PAIRS} SELECT condition, CAST(count(*) AS BIGINT) AS n, avg(CAST(success AS INT)) AS success_rate, (SELECT (count(*) FILTER (WHERE v) - count(*) FILTER (WHERE s)) / count(*) FROM pairs) AS difference FROM {FLAT} f WHERE design_cell = 'primary' GROUP BY condition")
def figure_success_by_condition(spark, d):
    """The figure's points; the interval is that of ``paired_interval``."""
    return plots.success_by_condition(_frame(spark, d)).drop("ci_lower", "ci_upper")


@query(f"SELECT condition, avg(wall_ms) AS wall_ms_mean, avg(model_ms) AS model_ms_mean, avg(retrieval_ms) AS retrieval_ms_mean, avg(tool_ms) AS tool_ms_mean, avg(estimated_cost_usd) AS estimated_cost_usd_mean FROM {FLAT} f WHERE design_cell = 'primary' GROUP BY condition")
def figure_efficiency(spark, d):
    return plots.efficiency(_frame(spark, d))


@query(f"SELECT failure_class, condition, CAST(count(*) AS BIGINT) AS count FROM ({LABELLED}) l WHERE design_cell = 'primary' GROUP BY ALL")
def figure_failure_modes(spark, d):
    return plots.failure_modes(base.nested_runs(spark, d))


@query(f"WITH {PAIRS} SELECT o.outcome, CAST(count(p.task_id) AS BIGINT) AS count FROM (SELECT unnest(['both_succeed', 'snippets_only', 'vfs_only', 'both_fail']) AS outcome) o LEFT JOIN (SELECT *, {OUTCOME} AS outcome FROM pairs) p USING (outcome) GROUP BY o.outcome")
def figure_paired_outcomes(spark, d):
    return plots.paired_outcomes(_frame(spark, d))


# Checks, cache, windows


@query(f"SELECT 'run_key_unique' AS rule, run_key AS key FROM ({RUNS}) r GROUP BY run_key HAVING count(*) > 1 UNION ALL SELECT 'token_limit', run_key FROM ({RUNS}) r WHERE input_tokens + output_tokens > token_limit")
def run_violations(spark, d):
    return validation.run_violations(base.nested_runs(spark, d))


@query("SELECT 'order' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS prev FROM orders) x WHERE prev >= o_custkey")
def order_violations(spark, d):
    return validation.out_of_order(base.base(spark, d, "SELECT o_custkey, o_orderkey FROM orders", "orders"), "o_custkey", "o_orderkey", "order")


@query(f"SELECT sha256(CAST(e.event_id % 50 AS VARCHAR)) AS cache_key, CAST(count(*) AS BIGINT) AS n, e.event_id % 50 < 25 AS cache_hit FROM events e GROUP BY e.event_id % 50")
def cache_lookup(spark, d):
    from textloom.sources.cache import with_cached

    key = F.sha2((F.col("event_id") % 50).cast("string"), 256).alias("cache_key")
    e = base.base(spark, d, "SELECT event_id FROM events", "events")
    kept = e.filter("event_id % 50 < 25").select(key, F.lit("{}").alias("response"))
    return with_cached(e.select(key), kept).groupBy("cache_key", "cache_hit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from textloom.streaming.runs import event_windows as windows

    w = windows(base.base(spark, d, "SELECT ts, event_type, value FROM events", "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")

"""More queries: sources, coercions, checks, packing and whole runs, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions import text as T
from textloom.operators import aggregates, bm25, chunking, evidence, failures, runs, validation, vfs
from textloom.operators.designs import CELLS, CONDITIONS
from textloom.plans import base
from textloom.plans.base import ASKED, FILES, RUNS
from textloom.plans.queries import BM25, CHUNK_SQL, DESIGN_SQL, DOC_CHUNKS, EXPOSED, LINES, RANKED, ROLLED, SQL, TOKEN, _design, _documents, _shown, norm_sql, query, terms_sql, tokens_sql
from textloom.sources import corpus, derived, jsonl, scratch
from textloom.sources.client import KnowsTheAnswer
from textloom.sources.config import load_config

# Files of JSON lines


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def jsonl_roundtrip(spark, d):
    """A table written as JSON lines and read back with its types and all checks."""
    made = base.base(spark, d, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", "customer")
    path = scratch.folder(spark)
    jsonl.write_jsonl(made, path)
    return jsonl.read_jsonl(spark, path, made.schema)


@query("SELECT n_nationkey, n_name, CAST(3 AS BIGINT) AS n FROM nation")
def jsonl_appends(spark, d):
    made = base.base(spark, d, "SELECT n_nationkey, n_name FROM nation", "nation")
    path = scratch.folder(spark)
    for _ in range(3):
        jsonl.append_jsonl(made, path)
    return jsonl.read_jsonl(spark, path, made.schema).groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


CORPUS_ID = "'doc-' || source || '-' || lpad(CAST(doc_id AS VARCHAR), 9, '0')"


def _as_corpus(spark, d) -> DataFrame:
    made = base.base(spark, d, f"SELECT {CORPUS_ID} AS doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, source AS category, text AS content FROM documents", "documents")
    extra = {"schema_version": F.lit(1), "corpus_version": F.lit("v1"), "title": F.col("category"), "generator_seed": F.lit(0), "facts": F.array()}
    return made.select(*(extra.get(f.name, F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(corpus.DOCUMENT)))


@query(f"SELECT {CORPUS_ID} AS doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, source AS category, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest FROM documents")
def corpus_roundtrip(spark, d):
    """The documents as a corpus, written, read strictly, and found to break no rule."""
    path = scratch.folder(spark)
    jsonl.write_jsonl(_as_corpus(spark, d), path)
    docs = corpus.load_corpus(spark, path)
    wrong = validation.document_violations(docs).select(F.col("key").alias("doc_id")).distinct()
    return docs.join(wrong, "doc_id", "left_anti").select("doc_id", "path", "category", F.length("content").cast("long").alias("n_chars"), T.digest(F.col("content")).alias("digest"))


@query(f"SELECT run_key, condition = 'vfs' AS mock FROM ({RUNS}) r")
def marked_runs(spark, d):
    made = base.nested_runs(spark, d)
    return jsonl.mark_mock(made, made.filter("condition = 'vfs'").select("run_key")).select("run_key", F.col("scoring_details.mock_oracle_policy").alias("mock"))


# Tasks and values


@query("SELECT 'task-eval-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS task_id FROM customer WHERE c_custkey % 3 > 0 ORDER BY task_id LIMIT 40")
def first_eval_tasks(spark, d):
    """The first tasks of a split, by their ids."""
    t = base.base(spark, d, "SELECT c_custkey FROM customer", "customer").withColumn("split", F.when(F.col("c_custkey") % 3 > 0, "eval").otherwise("dev"))
    t = t.withColumn("task_id", F.concat(F.lit("task-"), "split", F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")))
    return runs.first_tasks(t, "eval", 40).select("task_id")


VALUES = ("true", " YES ", "0", "1.0", "no", "maybe", "nan", "Infinity", "12", "3.5", "", "-7", "False")
SAID = f"SELECT event_id, list_extract([{', '.join(f"'{v}'" for v in VALUES)}], CAST(event_id % {len(VALUES)} AS INT) + 1) AS v FROM events"


@query(f"WITH s AS (SELECT event_id, lower(trim(v)) AS t, CASE WHEN isfinite(try_cast(v AS DOUBLE)) THEN try_cast(v AS DOUBLE) END AS x FROM ({SAID}) z) SELECT event_id, CASE WHEN t IN ('true', 'yes', '1', '1.0') THEN true WHEN t IN ('false', 'no', '0', '0.0') THEN false END AS truth, x AS number, CASE WHEN x = floor(x) THEN CAST(x AS BIGINT) END AS whole FROM s")
def coerced_values(spark, d):
    e = base.base(spark, d, "SELECT event_id FROM events", "events")
    v = F.element_at(F.array(*map(F.lit, VALUES)), (F.col("event_id") % len(VALUES)).cast("int") + 1)
    return e.select("event_id", runs.as_boolean(v).alias("truth"), runs.as_number(v).alias("number"), runs.as_integer(v).alias("whole"))


@query("SELECT doc_id, '{\"category\":\"' || source || '\",\"doc_id\":' || CAST(doc_id AS VARCHAR) || ',\"lang\":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '\"' || lang || '\"' END || '}' AS json, sha256(text) AS digest FROM documents")
def canonical_texts(spark, d):
    docs = base.base(spark, d, "SELECT doc_id, source, lang, text FROM documents", "documents")
    one = F.struct(F.col("source").alias("category"), "doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("lang")).alias("lang"))
    return docs.select("doc_id", T.canonical_json(one).alias("json"), T.digest(F.col("text")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, t[1] AS first_term FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents) x")
def exact_terms(spark, d):
    """Terms of the exact normal form, which is the built-in one where text has no compatibility characters."""
    t = base.files(spark, d).select("doc_id", T.terms(F.col("text"), exact=True).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.get("t", F.lit(0)).alias("first_term"))


#: Ids of all kinds, right and wrong, made of the names and keys of parts.
NAMED = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'doc-' || lower(replace(p_type, ' ', '-')) || '-' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') WHEN 1 THEN 'doc-' || p_type || '-' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') WHEN 2 THEN 'doc-' || lower(replace(p_type, ' ', '-')) || '-' || CAST(p_partkey AS VARCHAR)
WHEN 3 THEN 'fact-' || CAST(p_partkey * 1009 AS VARCHAR) WHEN 4 THEN 'fact-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 5 THEN 'task-' || CASE WHEN p_size % 3 = 0 THEN 'dev' WHEN p_size % 3 = 1 THEN 'eval' ELSE 'test' END || '-' || lpad(CAST(p_partkey AS VARCHAR), 5 + p_size % 2, '0')
WHEN 6 THEN 'doc-' || lower(replace(p_type, ' ', '-')) || '-0001::c' || lpad(CAST(p_partkey AS VARCHAR), 3 + p_size % 3, '0') WHEN 7 THEN lower(replace(p_type, ' ', '--')) || '-0001' ELSE 'doc-' || lower(replace(p_type, ' ', '--')) || '-0001' END AS v FROM part"""
_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
_digits = lambda x, n: f"(length({x}) >= {n} AND translate({x}, '{_DIGITS}', '') = '')"


@query(f"""WITH n AS ({NAMED}), w AS (SELECT *, string_split(v, '-') AS w, string_split(v, '::c') AS c FROM n)
SELECT p_partkey, w[1] = 'doc' AND len(w) >= 3 AND {_digits('w[-1]', 4)} AND len(list_filter(w, lambda x: x = '' OR translate(x, '{_SMALL}', '') <> '')) = 0 AS is_doc,
len(c) = 2 AND starts_with(c[1], 'doc-') AND length(c[1]) > 4 AND translate(c[1], '{_SMALL}-', '') = '' AND {_digits('c[2]', 4)} AS is_chunk,
starts_with(v, 'fact-') AND {_digits('substr(v, 6)', 6)} AS is_fact, (starts_with(v, 'task-dev-') AND {_digits('substr(v, 10)', 6)}) OR (starts_with(v, 'task-eval-') AND {_digits('substr(v, 11)', 6)}) AS is_task FROM w""")
def id_grammar(spark, d):
    """Ids against their grammars; the SQL takes them apart instead."""
    rules = {"is_doc": validation.DOC_ID, "is_chunk": validation.CHUNK_ID, "is_fact": validation.FACT_ID, "is_task": validation.TASK_ID}
    return base.base(spark, d, NAMED, "part").select("p_partkey", *(F.rlike("v", F.lit(rule)).alias(n) for n, rule in rules.items()))


# Texts cut to tokens


def head_sql(x: str, most: int) -> str:
    """The longest prefix that ends with one of the first tokens, for texts whose normal form has as many tokens as they have."""
    return f"CASE WHEN {tokens_sql(x)} <= {most} THEN {x} ELSE regexp_extract({x}, '(?s)^(?:.*?(?:{TOKEN})){{{most}}}') END"


SQL["truncated_texts"] = f"SELECT doc_id, head, CAST({tokens_sql('head')} AS BIGINT) AS n_tokens FROM (SELECT doc_id, {head_sql('text', 50)} AS head FROM documents) x"


@query(f"""WITH h AS (SELECT doc_id, text, {head_sql('text', 40)} AS head FROM documents), b AS (SELECT doc_id, no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - 1 AS BIGINT) AS upto FROM {LINES} x)
SELECT h.doc_id, head, CAST(CASE WHEN head = text THEN (SELECT count(*) FROM b WHERE b.doc_id = h.doc_id) ELSE length(head) - length(replace(head, chr(10), '')) + CASE WHEN substr(text, length(head) + 1, 1) = chr(10) THEN 1 ELSE 0 END END AS INT) AS n_lines,
CAST((SELECT count(*) FROM b WHERE b.doc_id = h.doc_id AND upto <= length(head)) AS INT) AS n_blocks FROM h""")
def fitted_contents(spark, d):
    """What fits of a result, and how many of its lines and blocks (here its lines) are shown whole."""
    docs = base.files(spark, d)
    x = docs.withColumn("head", vfs.fit_content(F.col("text"), F.lit(40), F.lit(90)))
    return x.select("doc_id", "head", vfs.visible_lines(F.col("text"), F.col("head")).cast("int").alias("n_lines"), vfs.visible_blocks(T.lines(F.col("text")), F.col("head")).alias("n_blocks"))


CHUNKED = CHUNK_SQL[: CHUNK_SQL.rindex("SELECT CAST(doc_id AS VARCHAR)")] + ", c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, last, piece) - 1 AS INT) AS chunk_index, no, last, piece FROM w)"
CHUNK_NAME = "CAST(c.doc_id AS VARCHAR) || '::c' || lpad(CAST(c.chunk_index AS VARCHAR), 4, '0')"


@query(f"""{CHUNKED}, t AS (SELECT doc_id, no, line, CAST({tokens_sql('line')} AS BIGINT) AS n, regexp_extract_all(line, '{TOKEN}') AS shown FROM {LINES} x)
SELECT {CHUNK_NAME} AS chunk_id, CASE WHEN max(t.n) > 180 THEN max(array_to_string(t.shown[150 * piece + 1 : 150 * piece + 180], ' ')) ELSE string_agg(line, chr(10) ORDER BY t.no) END AS text FROM c JOIN t ON t.doc_id = c.doc_id AND t.no BETWEEN c.no AND c.last GROUP BY ALL""")
def chunk_texts(spark, d):
    return chunking.chunk_documents(base.files(spark, d)).select("chunk_id", "text")


SQL["chunk_facts"] = f"""{CHUNKED} SELECT {CHUNK_NAME} AS chunk_id, CAST(no AS INT) AS start_line, CAST(last AS INT) AS end_line, array_to_string(list_sort(list_filter([CASE WHEN no <= 1 AND last >= 1 THEN 'fact-' || c.doc_id || '-1' END, CASE WHEN no <= 3 AND last >= 3 THEN 'fact-' || c.doc_id || '-3' END], lambda x: x IS NOT NULL)), ',') AS fact_ids FROM c"""


@query(SQL["chunk_facts"])
def chunk_facts(spark, d):
    """Fact ids of chunks: two spans a document stand in for facts."""
    docs = base.files(spark, d)
    spans = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("line_start")).select(F.concat(F.lit("fact-"), "doc_id", F.lit("-"), "line_start").alias("fact_id"), "doc_id", "line_start", F.col("line_start").alias("line_end"))
    return chunking.with_fact_ids(chunking.chunk_documents(docs), spans).select("chunk_id", "start_line", "end_line", F.array_join("fact_ids", ",").alias("fact_ids"))


# Retrieval

#: Every chunk that a query scores below zero is no hit; those without a term of it score 0.
SQL["bm25_padded_topk"] = f"""WITH {DOC_CHUNKS}, {BM25}, every AS (SELECT q.query_id, c.chunk_id, coalesce(s.score, 0) AS score FROM asked q CROSS JOIN c LEFT JOIN scored s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM every WHERE score >= 0) SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 8"""


@query(SQL["bm25_padded_topk"].replace(ASKED, "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'nowherefound' ELSE 'nowherefound ' || regexp_extract(text, '[a-z]+') END AS query FROM benchmark"))
def bm25_padding(spark, d):
    """Queries of one or two words, of which half meet no chunk at all: the rest of the list is filled up."""
    few = base.base(spark, d, "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'nowherefound' ELSE 'nowherefound ' || regexp_extract(text, '[a-z]+', 0) END AS query FROM benchmark", "benchmark")
    return bm25.search(bm25.build_index(_documents(spark, d)), few, 8).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {DOC_CHUNKS}, {BM25}, {RANKED.format('')}, {ROLLED}, o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, doc_id) AS rank FROM rolled) SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM o WHERE rank <= 5")
def initial_candidates(spark, d):
    hits = bm25.search(bm25.build_index(_documents(spark, d)), base.asked(spark, d), 8, pad=False)
    return bm25.initial_candidates(bm25.document_hits(hits)).select("query_id", "doc_id", "rank")


_TREE = """c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256('=' || CAST(doc_id AS VARCHAR) || chr(31) || CASE WHEN text IS NULL THEN '' ELSE '=' || text END) AS own FROM documents),
l4 AS (SELECT substr(sha256(chunk_id), 1, 4) AS prefix, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(own, '' ORDER BY chunk_id, own)) AS digest FROM c GROUP BY 1), """ + ", ".join(f"l{k} AS (SELECT substr(prefix, 1, {k}) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(prefix || ':' || digest, '' ORDER BY prefix)) AS digest FROM l{k + 1} GROUP BY 1)" for k in (3, 2, 1, 0))


@query(f"WITH {_TREE} SELECT sha256('chunks|word tokens|' || CAST(n AS VARCHAR) || '|' || digest) AS fingerprint FROM l0")
def corpus_fingerprint(spark, d):
    return bm25.corpus_fingerprint(_documents(spark, d), F.lit("chunks|word tokens"))


@query(f"WITH {_TREE} " + " UNION ALL ".join(f"SELECT prefix, n, digest FROM l{k}" for k in range(5)))
def corpus_tree(spark, d):
    """The digests of all ranges of documents, by which two copies of a corpus are compared."""
    return bm25.digest_tree(_documents(spark, d))


@query(f"""WITH asked AS (SELECT 1 AS query_id, 'License ouer' AS query), c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, path, text FROM ({FILES}) f), {BM25}, {RANKED.format('')},
l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(no AS INT) AS no, line, count(*) OVER (PARTITION BY doc_id) AS n FROM {LINES} x),
m AS (SELECT l.doc_id, l.path, greatest(1, no - 1) AS a, CAST(least(n, no + 1) AS INT) AS b, min(rank) AS rank, min(no) AS first_no FROM l JOIN ranked r ON r.doc_id = l.doc_id WHERE list_has_any({terms_sql('line')}, ['license', 'ouer']) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY rank, first_no, path, a) AS ordinal FROM m) SELECT CAST(ordinal AS INT) AS ordinal, path, CAST(a AS INT) AS start_line, b AS end_line FROM o WHERE ordinal <= 30""")
def vfs_grep_ranked(spark, d):
    """Lines that share a term with a query, in the order of BM25."""
    docs = base.files(spark, d)
    asked = spark.createDataFrame([(1, "License ouer", 30)], "query_id int, query string, max_results int")
    index = bm25.build_index(_documents(spark, d))
    from pyspark.sql.window import Window

    scored = bm25.scores(index, asked).filter("score >= 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    whole = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "path", F.lit(1).alias("start_line"), "text")
    return vfs.grep(vfs.build_lines(docs, whole), ranked, asked).select("ordinal", "path", "start_line", "end_line")


#: Paths of many forms, made of URLs.
RAW = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN substr(url, instr(url, '://') + 2) WHEN 2 THEN substr(url, instr(url, '://') + 3) WHEN 3 THEN replace(substr(url, instr(url, '://') + 3), '/', '//') WHEN 4 THEN replace(substr(url, instr(url, '://') + 3), '/', '/./')
WHEN 5 THEN '../' || substr(url, instr(url, '://') + 3) WHEN 6 THEN substr(url, 1, 0) WHEN 7 THEN replace(substr(url, instr(url, '://') + 2), '.', '%2e') ELSE substr(url, instr(url, '://') + 2, 12) || '/' END AS raw FROM pages"""


@query(f"""WITH r AS ({RAW}), c AS (SELECT *, CASE WHEN starts_with(raw, '/') THEN substr(raw, 2) ELSE raw END AS bare FROM r),
e AS (SELECT *, CASE WHEN trim(raw) = '' OR contains(raw, '//') OR contains(raw, '%') OR contains(raw, chr(92)) OR (instr(raw, ':') > 1 AND translate(substr(raw, 1, instr(raw, ':') - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-', '') = '' AND NOT contains('0123456789+.-', substr(raw, 1, 1))) THEN 'INVALID_PATH' WHEN list_has_any(string_split(bare, '/'), ['.', '..']) THEN 'PATH_TRAVERSAL' END AS error_code FROM c)
SELECT page_id, raw, error_code, CASE WHEN error_code IS NULL THEN '/' || CASE WHEN ends_with(bare, '/') THEN substr(bare, 1, length(bare) - 1) ELSE bare END END AS canonical FROM e""")
def path_forms(spark, d):
    """What is wrong with paths, and how they are written."""
    raw = F.col("raw")
    return base.base(spark, d, RAW, "pages").select("page_id", "raw", vfs.path_error(raw).alias("error_code"), vfs.canonical_path(raw).alias("canonical"))


@query(f"""WITH f AS (SELECT doc_id, category AS source, path FROM ({FILES}) x), r AS (SELECT doc_id, source, path, doc_id % 6 AS k FROM f)
SELECT doc_id AS request_id, CASE k WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN '/' || source WHEN 3 THEN '/' || source WHEN 4 THEN path || '/more.md' ELSE '/' || source || '/none.md' END AS path,
CASE k WHEN 1 THEN 'NOT_A_DIRECTORY' WHEN 2 THEN 'NOT_A_FILE' WHEN 4 THEN 'NOT_A_DIRECTORY' WHEN 5 THEN 'NOT_FOUND' END AS error_code FROM r""")
def vfs_resolve(spark, d):
    """Files and directories asked for as what they are and as what they are not, paths through files, and paths that lead nowhere."""
    docs = base.files(spark, d)
    k, folder = F.col("doc_id") % 6, F.concat(F.lit("/"), "category")
    path = F.when(k < 2, F.col("path")).when(k < 4, folder).when(k == 4, F.concat("path", F.lit("/more.md"))).otherwise(F.concat(folder, F.lit("/none.md")))
    kind = F.when(k.isin(0, 2, 4, 5), "file").otherwise("directory")
    return vfs.resolve(vfs.build_tree(docs), docs.select(F.col("doc_id").alias("request_id"), path.alias("path"), kind.alias("kind")))


@query(f"SELECT r.request_id, f.path FROM ({FILES}) f JOIN (SELECT '/' || category AS request_id FROM (SELECT category FROM ({FILES}) x GROUP BY category ORDER BY category LIMIT 3) y UNION ALL SELECT '/') r ON r.request_id = '/' OR starts_with(f.path, r.request_id || '/')")
def vfs_files_below(spark, d):
    """The files below three directories and below the root."""
    tree = vfs.build_tree(base.files(spark, d))
    asked = tree.nodes.filter("is_dir AND parent = '/'").orderBy("node").limit(3).select("node").unionByName(spark.range(1).select(F.lit("/").alias("node")))
    return vfs.files_below(tree, asked.select(F.col("node").alias("request_id"), F.col("node").alias("path")))


#: Requests with arguments that are there or not, right or wrong, made of events.
REQUESTS = """SELECT event_id, CASE event_type WHEN 'view' THEN 'grep' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'cat' WHEN 'error' THEN 'delete' ELSE 'list' END AS tool, CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 < 4 THEN event_type END AS q, CASE WHEN event_id % 3 < 2 THEN CAST(event_id % 60 AS VARCHAR) WHEN event_id % 9 = 2 THEN 'many' END AS m,
CASE WHEN event_id % 4 > 0 THEN '/a' END AS p, CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 90 AS VARCHAR) ELSE 'one' END AS s, CASE WHEN event_id % 7 > 0 THEN '99' END AS e, CASE WHEN event_id % 11 = 0 THEN 'x' END AS more FROM events"""


@query(f"""SELECT event_id, tool, CASE WHEN tool = 'grep' AND (q IS NULL OR trim(q) = '' OR m IS NULL OR more IS NOT NULL OR TRY_CAST(m AS INT) IS NULL OR NOT TRY_CAST(m AS INT) BETWEEN 1 AND 50) THEN 'RESULT_LIMIT_INVALID' WHEN tool = 'read' AND (p IS NULL OR s IS NULL OR e IS NULL OR more IS NOT NULL OR TRY_CAST(s AS INT) IS NULL) THEN 'RANGE_INVALID'
WHEN (tool = 'cat' AND (p IS NULL OR more IS NOT NULL)) OR (tool = 'list' AND more IS NOT NULL) OR tool = 'delete' THEN 'INVALID_PATH' END AS error_code FROM ({REQUESTS}) r""")
def request_errors(spark, d):
    """The code that refuses a request by its arguments."""
    own = {"grep": {"query": "q", "max_results": "m", "path": "p", "more": "more"}, "read": {"path": "p", "start_line": "s", "end_line": "e", "more": "more"}}
    either = {"path": "p", "more": "more"}
    given = lambda names: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in names.items())), lambda x: x["v"].isNotNull()))
    arguments = F.when(F.col("tool") == "grep", given(own["grep"])).when(F.col("tool") == "read", given(own["read"])).otherwise(given(either))
    return base.base(spark, d, REQUESTS, "events").select("event_id", "tool", vfs.request_error(F.col("tool"), arguments).alias("error_code"))


# Evidence and failures

SQL["accessed_evidence"] = f"""WITH {EXPOSED}, i AS (SELECT *, max(end_line) OVER (PARTITION BY run_id, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM shown),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM i), m AS (SELECT run_id, path, min(start_line) AS a, max(end_line) AS b FROM n GROUP BY run_id, path, island),
g AS (SELECT run_id, array_to_string(list(path || ':' || a || '-' || b ORDER BY path, a, b), ' ') AS ranges FROM m GROUP BY run_id), f AS (SELECT run_id, array_to_string(list_sort(list(DISTINCT fact_id)), ' ') AS fact_ids FROM exposed GROUP BY run_id)
SELECT run_id, coalesce(fact_ids, '') AS fact_ids, coalesce(fact_ids, '') AS doc_ids, ranges FROM g LEFT JOIN f USING (run_id)"""


@query(SQL["accessed_evidence"])
def accessed_evidence(spark, d):
    """Facts, documents (here one a fact) and merged line ranges that the calls of a run touched."""
    chunk = base.facts(spark, d).select(F.concat("fact_id", F.lit("::c0000")).alias("chunk_id"), F.col("fact_id").alias("doc_id"), "path", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"))
    got = evidence.accessed_evidence(_shown(spark, d), base.facts(spark, d), chunk)
    ranges = F.transform("line_ranges", lambda r: F.concat(r["path"], F.lit(":"), r["start_line"].cast("string"), F.lit("-"), r["end_line"].cast("string")))
    return got.select("run_id", F.array_join("fact_ids", " ").alias("fact_ids"), F.array_join("doc_ids", " ").alias("doc_ids"), F.array_join(ranges, " ").alias("ranges"))


@query("SELECT user_id AS run_id, CAST(count(*) - CASE WHEN user_id % 3 < 2 THEN 1 ELSE 0 END AS INT) AS n_scored FROM events GROUP BY user_id")
def scored_traces(spark, d):
    """Calls whose results a model saw: not the last one of a run that a limit ended."""
    t = base.calls(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list("call_ordinal")).alias("trace"))
    end = F.when(F.col("run_id") % 3 == 0, "max_tool_calls").when(F.col("run_id") % 3 == 1, "budget_exhausted").otherwise("answered")
    return t.select("run_id", F.size(evidence.scored_trace(F.col("trace"), end)).alias("n_scored"))


SQL["trace_examples"] = f"""WITH p AS (SELECT task_id, min(run_key) FILTER (WHERE condition = 'snippets') AS sk, min(run_key) FILTER (WHERE condition = 'vfs') AS vk, bool_or(success) FILTER (WHERE condition = 'snippets') AS s, bool_or(success) FILTER (WHERE condition = 'vfs') AS v FROM ({RUNS}) r WHERE design_cell = 'primary' GROUP BY task_id HAVING count(DISTINCT condition) = 2),
k AS (SELECT CASE WHEN v AND NOT s THEN 'vfs_win' WHEN s AND NOT v THEN 'snippet_win' WHEN NOT s THEN 'both_fail' END AS example, task_id, CASE WHEN s AND NOT v THEN sk ELSE vk END AS run_key FROM p),
x AS (SELECT run_key FROM ({RUNS}) r WHERE design_cell = 'primary' AND condition = 'vfs' AND NOT success AND calls > 0 AND (repeated >= 3 OR repeated / calls >= 0.5) ORDER BY repeated DESC, task_id, run_key LIMIT 1)
SELECT example, arg_min(run_key, task_id) AS run_key FROM k WHERE example IS NOT NULL GROUP BY example UNION ALL SELECT 'excessive_tool_use', run_key FROM x"""


@query(f"SELECT run_key, CAST(list_position([{', '.join(f"'{c}'" for c in CELLS)}], design_cell) - 1 AS INT) AS cell_rank, CASE condition WHEN 'snippets' THEN 0 ELSE 1 END AS condition_rank FROM ({RUNS}) r")
def report_order(spark, d):
    """The ranks that order rows in reports."""
    frame = runs.in_order(runs.run_frame(base.nested_runs(spark, d)))
    return frame.select("run_key", runs.rank_of(F.col("design_cell"), CELLS).cast("int").alias("cell_rank"), runs.rank_of(F.col("condition"), CONDITIONS).cast("int").alias("condition_rank"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS assigned, CAST(count(*) FILTER (WHERE condition = 'vfs' AND design_cell = 'primary') AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE NOT (condition = 'vfs' AND design_cell = 'primary')) AS BIGINT) AS pending FROM ({DESIGN_SQL}) x")
def run_counts(spark, d):
    return runs.run_counts(_design(spark, d), _design(spark, d).filter("condition = 'vfs' and design_cell = 'primary'"))


@query(f"""WITH asked AS (SELECT DISTINCT category FROM ({RUNS}) r), two_hops AS (SELECT condition, count(*) AS n FROM ({RUNS}) r WHERE hops = 2 GROUP BY condition), few AS (SELECT condition, count(*) AS n FROM ({RUNS}) r WHERE category NOT IN (SELECT category FROM asked) GROUP BY condition)
SELECT 'some' AS asked, condition, CAST(n AS BIGINT) AS n, 'ok' AS status FROM two_hops UNION ALL SELECT 'some', NULL, NULL, 'not_run' WHERE NOT EXISTS (SELECT 1 FROM two_hops) UNION ALL SELECT 'few', condition, CAST(n AS BIGINT), 'ok' FROM few UNION ALL SELECT 'few', NULL, NULL, 'not_run' WHERE NOT EXISTS (SELECT 1 FROM few)""")
def empty_summary(spark, d):
    """A summary of some runs has its rows, and one of no runs is a row that says so."""
    frame = runs.run_frame(base.nested_runs(spark, d))
    parts = {"some": frame.filter("hop_count = 2"), "few": frame.join(frame.select("category").distinct(), "category", "left_anti")}
    each = [aggregates.or_not_run(part.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.lit("ok").alias("status"))).select(F.lit(name).alias("asked"), "condition", "n", "status") for name, part in parts.items()]
    return each[0].unionByName(each[1])


SQL["parsed_answers"] = "SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN text END AS answer, CASE WHEN item_id % 3 <> 0 THEN 1 END AS n_citations, false AS ends_run FROM benchmark"


# Integrity


def _tasks(spark, d) -> DataFrame:
    t = base.base(spark, d, "SELECT item_id, text FROM benchmark", "benchmark")
    n = F.lpad((F.col("item_id") % 30).cast("string"), 6, "0")
    return t.select(
        F.concat(F.lit("task-eval-"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("task_id"), F.when(F.col("item_id") % 2 == 0, "dev").otherwise("eval").alias("split"), F.col("text").alias("question"),
        F.array_sort(F.array_distinct(F.array(F.lit("fact-000000"), F.concat(F.lit("fact-"), n)))).alias("required_fact_ids"), F.array(F.concat(F.lit("doc-a-"), n)).alias("gold_document_ids"), F.array(F.concat(F.lit("doc-a-"), n, F.lit("::c0000"))).alias("gold_chunk_ids"),
        F.lit(2).alias("hop_count"), F.array(F.concat(F.lit("doc-a-"), F.lpad((F.col("item_id") % 7).cast("string"), 6, "0"))).alias("distractor_document_ids"), (F.col("item_id") % 2).cast("int").alias("distractor_count"),
    )


def _fact_documents(spark, d) -> DataFrame:
    """A document a nation, with one fact."""
    f = base.facts(spark, d)
    n = F.substring("fact_id", 6, 20)
    return f.select(F.concat(F.lit("doc-a-"), n).alias("doc_id"), F.concat(F.lit("/a/"), n, F.lit(".md")).alias("path"), F.lit("a").alias("category"), F.concat(F.lit("text of "), "fact_id").alias("content"), F.array(F.struct("fact_id", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))).alias("facts"))


TASK_NO = "'task-eval-' || lpad(CAST(item_id AS VARCHAR), 6, '0')"


@query(f"""SELECT 'facts_exist' AS rule, {TASK_NO} AS key FROM benchmark WHERE item_id % 30 >= 25 UNION ALL SELECT 'gold_documents_exist', {TASK_NO} FROM benchmark WHERE item_id % 30 >= 25 UNION ALL SELECT 'gold_chunks_exist', {TASK_NO} FROM benchmark WHERE item_id % 30 >= 25
UNION ALL SELECT 'hop_count', {TASK_NO} FROM benchmark WHERE item_id % 30 = 0 UNION ALL SELECT 'distractor_count', {TASK_NO} FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'gold_and_distractors_apart', {TASK_NO} FROM benchmark WHERE item_id % 30 = item_id % 7""")
def task_violations(spark, d):
    """Rules that made-up tasks break: facts, documents and chunks that are not there, wrong counts, distractors that are gold."""
    docs = _fact_documents(spark, d)
    chunks = docs.select(F.concat("doc_id", F.lit("::c0000")).alias("chunk_id"))
    return validation.task_violations(_tasks(spark, d), docs, chunks)


@query(f"""WITH t AS (SELECT {TASK_NO} AS key, item_id % 30 AS n, item_id % 7 AS o, item_id % 2 AS s, {norm_sql('text')} AS q FROM benchmark), u AS (SELECT n AS doc, s FROM t UNION ALL SELECT o, s FROM t), b AS (SELECT doc FROM u GROUP BY doc HAVING count(DISTINCT s) > 1)
SELECT 'facts_in_two_documents' AS rule, key FROM t WHERE n = 0 OR n >= 25 UNION ALL SELECT 'no_chunk_holds_all_facts', key FROM t WHERE n = 0 UNION ALL SELECT 'splits_apart', 'doc-a-' || lpad(CAST(doc AS VARCHAR), 6, '0') FROM b
UNION ALL SELECT 'questions_unique', min(key) FROM t GROUP BY q HAVING count(*) > 1""")
def leakage_gates(spark, d):
    docs = _fact_documents(spark, d)
    chunks = docs.select(F.concat("doc_id", F.lit("::c0000")).alias("chunk_id"), "doc_id", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return validation.leakage_violations(_tasks(spark, d), docs, chunks)


# Streams


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """Events read as a stream, in batches of one file, with the windows' counts as its state."""
    from textloom.streaming import runs as streaming

    made, source = scratch.folder(spark), base.base(spark, d, "SELECT ts, event_type, value FROM events", "events")
    source.repartition(4).write.parquet(made)
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(made)
    target = scratch.folder(spark)
    streaming.refresh_windows(events, target, scratch.folder(spark)).awaitTermination()
    return streaming.latest(spark, target).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query(SQL["condition_summary"])
def streamed_summary(spark, d):
    """The summary of runs that come as a stream of files, one of which comes twice: as if they had been read at once."""
    from textloom.operators.runs import RUN_RECORD
    from textloom.sources.jsonl import append_jsonl
    from textloom.streaming import runs as streaming

    made, target, state = scratch.folder(spark), scratch.folder(spark), scratch.folder(spark)
    every = base.nested_runs(spark, d).select(*StructType.fromDDL(RUN_RECORD).fieldNames())
    for part in (0, 1, 0, 2):
        append_jsonl(every.filter(F.pmod(F.xxhash64("run_key"), F.lit(3)) == part), made)
        streaming.refresh_summary(streaming.stream_runs(spark, made, 1), target, state).awaitTermination()
    return streaming.latest(spark, target)


# Derived corpora and whole runs

_SEATS = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("""SELECT 'doc-suppliers-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS doc_id, sha256('# ' || s_name || chr(10) || s_name || ' has its seat in ' || n_name || '.' || chr(10) || 'The account of ' || s_name || ' stands at ' || printf('%.2f', s_acctbal) || '.') AS digest, CAST(2 AS INT) AS n_facts FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'doc-nations-' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0'), sha256('# ' || n_name || chr(10) || n_name || ' is counted to the region ' || r_name || '.'), 1 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def derived_corpus(spark, d):
    docs, _ = derived.from_tables(spark, d)
    return docs.select("doc_id", F.sha2("content", 256).alias("digest"), F.size("facts").alias("n_facts"))


@query(f"""SELECT 'task-' || CASE WHEN n_nationkey % 2 = 0 THEN 'dev' ELSE 'eval' END || '-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS task_id, r_name AS canonical_answer, 'doc-nations-' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || '::c0000,doc-suppliers-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '::c0000' AS gold_chunks,
(SELECT CAST(count(*) AS INT) FROM (SELECT 1 FROM nation o WHERE o.n_nationkey % 2 = nation.n_nationkey % 2 AND o.n_nationkey > nation.n_nationkey LIMIT 2) x) AS distractor_count FROM {_SEATS}""")
def derived_tasks(spark, d):
    _, tasks = derived.from_tables(spark, d)
    return tasks.select("task_id", "canonical_answer", F.array_join("gold_chunk_ids", ",").alias("gold_chunks"), "distractor_count")


@query(f"SELECT rule, CAST(0 AS BIGINT) AS n FROM (SELECT 'all' AS rule) x WHERE (SELECT count(*) FROM {_SEATS}) > 0 UNION ALL SELECT 'leaks', (SELECT count(*) FROM {_SEATS.replace('supplier', 'supplier s')} JOIN supplier o ON contains(o.s_name, 'To which region is the nation counted in which ' || s.s_name || ' has its seat?'))")
def derived_rules(spark, d):
    """Violations of a derived corpus and its tasks, and questions that stand in a document."""
    docs, tasks = derived.from_tables(spark, d)
    chunks = chunking.chunk_documents(docs.withColumnRenamed("content", "text"))
    broken = corpus.violations(docs, tasks, chunks).unionByName(validation.leakage_violations(tasks, docs, chunks)).select("key")
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    return counted(broken, "all").unionByName(counted(validation.leaks(tasks.withColumnRenamed("question", "question"), docs), "leaks"))


@query(f"SELECT condition, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS successes, CAST(0 AS BIGINT) AS calls_beside_facts, CAST(count(*) AS BIGINT) AS n_timed FROM {_SEATS} CROSS JOIN (SELECT unnest(['snippets', 'vfs']) AS condition) c WHERE n_nationkey % 2 = 1 GROUP BY condition")
def experiment_outcomes(spark, d):
    """Both conditions end to end over the tasks of a derived corpus, asked of a model that knows the answers: all are right, the tool loop makes a call
    a fact, and every run has times and a call of the model."""
    from textloom.operators.experiment import run_experiment

    scratch.shared_dir(spark)  # checkpoints need a folder
    docs, tasks = derived.from_tables(spark, d)
    made = run_experiment(docs, tasks.filter("split = 'eval'"), load_config(overrides={"experiment": {"experiment_id": "exp", "token_limit": 8192}}, environment={}), KnowsTheAnswer())
    beside = F.when(F.col("condition") == "vfs", F.abs(F.col("tool_call_count") - F.col("hop_count"))).otherwise(F.col("tool_call_count"))
    timed = (F.col("latency.wall_ms") >= F.col("latency.model_ms") + F.col("latency.tool_ms")) & (F.col("latency.retrieval_ms") > 0) & (F.size("token_accounting.turns") == F.col("tool_call_count") + 1)
    return made.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_if("correctness").alias("successes"), F.sum(beside).cast("long").alias("calls_beside_facts"), F.count_if(timed).alias("n_timed"))


@query(f"SELECT run_key FROM ({RUNS}) r WHERE category IN (SELECT category FROM ({RUNS}) x GROUP BY category ORDER BY category LIMIT 1) OR hops = 3")
def other_provenance(spark, d):
    """Runs that stem from another experiment or corpus than the one to be resumed: here those of one category and those of three hops."""
    from textloom.operators.designs import provenance_mismatches

    made = base.nested_runs(spark, d)
    first = made.agg(F.min("category")).first()[0]
    made = made.withColumns({"experiment_id": F.when(F.col("category") == first, "older").otherwise(F.col("experiment_id")), "corpus_version": F.when(F.col("hop_count") == 3, "v0").otherwise(F.col("corpus_version"))})
    return provenance_mismatches(made, {"experiment_id": "exp", "corpus_version": "v1"}).select("run_key")


@query(f"SELECT run_key, condition, success AS correctness, termination AS termination_reason, calls AS tool_call_count FROM ({RUNS}) r WHERE NOT success AND design_cell = 'primary'")
def public_payloads(spark, d):
    """What may be shown of a run, as JSON, read back."""
    lost = base.nested_runs(spark, d).filter("not correctness and design_cell = 'primary'")
    p = failures.public_payload(lost).select(F.from_json("payload", "run_key string, condition string, correctness boolean, termination_reason string, tool_call_count int").alias("p"))
    return p.select("p.*")

"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

from . import mixing, quality, queries

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _words(x: str) -> str:
    return WORDS.format(x)


def _lines(x: str) -> str:
    return rf"list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"


def _quartiles(level: str) -> str:
    out = [f"quantile_disc({m}, {q}) AS {m}_{name}" for m in quality.MEASURES for q, name in ((0.25, "q1"), (0.75, "q3"))]
    return f"SELECT {level}, CAST(count(*) AS DOUBLE) AS n, {', '.join(out)} FROM u GROUP BY ALL"


def _outside() -> str:
    def blended(c: str) -> str:
        of = lambda at, x: f"({at}.n * {at}.{c} + {quality.PRIOR_ROWS}.0 * {x}) / ({at}.n + {quality.PRIOR_ROWS}.0)"
        return of("o", of("g", f"a.{c}"))

    def rule(m: str, below: bool) -> str:
        lo, hi = blended(f"{m}_q1"), blended(f"{m}_q3")
        room = f"{quality.REACH} * ({hi} - {lo})"
        cond = f"{m} > {hi} + {room}" + (f" OR {m} < {lo} - {room}" if below else "")
        return f"CASE WHEN NOT base_failed AND ({cond}) THEN '{m}' END"

    return f"concat_ws(',', {', '.join(rule(m, below) for m, below in quality.MEASURES.items())})"


OP2 = f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, {_words('text')} AS w FROM d), i AS (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w), k AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM i),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM k) x WHERE n > 1), p AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS pos FROM r) y GROUP BY row),
c AS (SELECT d.*, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len({_lines('text')}) AS BIGINT) AS n_lines, CAST(len({_lines('text')}) - len(list_distinct({_lines('text')})) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN w USING (row) LEFT JOIN p USING (row)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length, ln((n_symbols + 0.5::DOUBLE) / (word_chars + 1.0::DOUBLE)) AS symbol_odds, ln((n_dup_lines + 0.5::DOUBLE) / (n_lines + 1.0::DOUBLE)) AS dup_line_odds, ln((n_repeat_words + 0.5::DOUBLE) / (n_words + 1.0::DOUBLE)) AS repeat_odds FROM c),
u AS (SELECT DISTINCT * EXCLUDE (doc_id, text, row) FROM m WHERE NOT base_failed), o AS ({_quartiles('lang, source')}), g AS ({_quartiles('lang')}), a AS ({_quartiles('1 AS one')}), j AS (SELECT m.*, {_outside()} AS outside FROM m LEFT JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang LEFT JOIN a ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside = '' AS kept, outside FROM j"""

#: CRC-32 by its table: 256 entries of eight steps each, then one step a byte.
CRC = """t AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8), crc AS (SELECT list(c ORDER BY i) AS crc FROM t WHERE k = 8)"""
BYTES = "list_transform(range(1, 2 * octet_length(encode(text)), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)"


def _draw(shard: int) -> str:
    return f"{{'draw': -ln((CAST('0x' || substr(md5('{shard}|' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0), 'shard': {shard}}}"


def _shard(n: int) -> str:
    return f"list_min([{', '.join(map(_draw, range(n)))}]).shard"


OP3 = f"""WITH RECURSIVE {CRC}, d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, coalesce(text, '') AS text, hex(coalesce(text, '')) AS h FROM documents),
s AS (SELECT doc_id, key, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32, CAST({_shard(8)} AS INT) AS shard, CAST({_shard(9)} AS INT) AS grown_shard FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(key || '|' || size || '|' || text_crc32), doc_id) - 1 AS BIGINT) AS slot, grown_shard FROM s"""

def _told(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


OP4 = f"""WITH RECURSIVE rec AS (SELECT md5({_told('doc_id')} || {_told('source')} || {_told('md5(text)')}) AS key, doc_id, source, {_told('source')} AS s, CAST(coalesce(len({_words('text')}), 0) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY doc_id, source, text),
tot AS (SELECT s, CAST(sum(tokens * copies) AS BIGINT) AS n FROM rec GROUP BY s),
ends AS (SELECT min(n) / max(n) AS least, max(n) AS most FROM tot WHERE n > 0), b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL SELECT i + 1, CASE WHEN pow(least, (lo + hi) / 2 - 1) <= 2 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(least, (lo + hi) / 2 - 1) <= 2 THEN (lo + hi) / 2 ELSE hi END FROM b, ends WHERE i < {mixing.STEPS}),
x AS (SELECT CASE WHEN pow(least, -1) <= 2 THEN 0 ELSE round(hi, 9) END AS x, most FROM b, ends WHERE i = {mixing.STEPS}), q AS (SELECT s, n, CASE WHEN n > 0 THEN greatest(CAST(round(most * pow(n / most, x)) AS BIGINT), n) ELSE 0 END AS quota FROM tot, x),
shape AS (SELECT greatest(1, CAST(ceil(sum(quota) / 1048576.0) AS BIGINT)) AS blocks, (SELECT greatest(1, CAST(ceil(count(*) FILTER (WHERE tokens = 0) / 65536.0) AS BIGINT)) FROM rec) AS rooms FROM q), e AS (SELECT rec.*, n, quota, unnest(range(0, greatest(1, CAST(ceil(quota / greatest(n, 1)) AS BIGINT)))) AS epoch FROM rec JOIN q USING (s)),
o AS (SELECT *, md5('mix|' || epoch || '|' || key) AS ord FROM e), p AS (SELECT *, epoch * n + coalesce(sum(tokens * copies) OVER (PARTITION BY s, epoch ORDER BY ord, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o),
k AS (SELECT *, CAST(CASE WHEN tokens = 0 THEN CAST('0x' || substr(ord, 1, 8) AS BIGINT) % greatest(blocks, rooms) ELSE least(floor(pos * blocks / greatest(quota, 1)), blocks - 1) END AS BIGINT) AS block FROM p, shape WHERE pos < quota OR (epoch = 0 AND tokens = 0))
SELECT doc_id, source, tokens, copies, CAST(epoch AS INT) AS epoch, block, CAST(row_number() OVER (PARTITION BY block ORDER BY reverse(ord), key) - 1 AS BIGINT) AS slot FROM k"""

OP7 = f"""WITH r(action, host, path) AS (VALUES {', '.join(map(str, queries.RULES))}), u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM u),
f AS (SELECT p.row, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY p.row ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.host || r.path DESC) AS n FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON f.row = p.row AND n = 1"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a) SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept FROM v JOIN reach ON vec_id = reach.a LEFT JOIN n ON vec_id = n.a GROUP BY vec_id, n"""


OP11 = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, row, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d), tf AS (SELECT doc_id, row, n, term, count(*) AS tf FROM e GROUP BY ALL), tot AS (SELECT count(*) AS documents, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x, tot), i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) y GROUP BY ALL),
s AS (SELECT item_id, q.text, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term), tot GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) r WHERE rank <= 10"""


def _encoded(column: str, value: str | None = None) -> str:
    v = f"CAST({value or column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_encoded(c, text if c == "text" else None) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


def _beside(table: str, group: str) -> str:
    part = f"PARTITION BY {group}, level, idx // 3 ORDER BY idx ROWS BETWEEN"
    return f"SELECT {group}, level, idx, coalesce(string_agg(digest, '') OVER ({part} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER ({part} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {table} WHERE n > 1"


OP13 = f"""WITH RECURSIVE {CRC}, f AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM f),
u AS (SELECT g, 0 AS level, idx, leaf AS digest, n FROM l UNION ALL SELECT g, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY g, level, idx // 3, n),
s AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT 0 AS one, 0 AS level, idx, subroot AS digest, n FROM s UNION ALL SELECT one, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM v WHERE n > 1 GROUP BY one, level, idx // 3, n),
ub AS ({_beside('u', 'g')}), vb AS ({_beside('v', 'one')}),
c AS (SELECT row, doc_id IS NOT NULL AND xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 2 = 0 AS tampered FROM l, crc),
p AS (SELECT row, g, 0 AS level, idx, n, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS fold FROM l JOIN c USING (row) UNION ALL SELECT row, p.g, p.level + 1, p.idx // 3, (n + 2) // 3, proof || before || after, sha256(before || fold || after) FROM p JOIN ub ON p.g = ub.g AND p.level = ub.level AND p.idx = ub.idx WHERE n > 1),
r AS (SELECT row, subroot, 0 AS level, s.idx, s.n, proof, fold FROM p JOIN s USING (g) WHERE p.n = 1 UNION ALL SELECT row, subroot, r.level + 1, r.idx // 3, (n + 2) // 3, proof || before || after, sha256(before || fold || after) FROM r JOIN vb ON r.level = vb.level AND r.idx = vb.idx WHERE n > 1)
SELECT doc_id, leaf, subroot, v.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = v.digest AS verified FROM r JOIN l USING (row), v WHERE r.n = 1 AND v.n = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_sharding": OP3, "op4_mixing": OP4, "op7_url_filters": OP7, "op9_embedding_near_dedup": OP9, "op11_bit_sliced_search": OP11, "op13_merkle_manifest": OP13}

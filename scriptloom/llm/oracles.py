"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others rest on automata, trained models or file formats; tests hold them against brute
force, round trips or held-out accuracy. SQL compares pairs plainly, by exact cosine and exact
set sizes, where the operators use hashing.
"""

from __future__ import annotations

from .queries import DOMAIN_SQL, WEIGHTS

PERCENT, EPOCHS, SEED = 120, 3, 17


def _weight(level: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {w}.0" for name, w in WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1.0 END" if cases else "1.0"


def _share(level: str, keys: list[str], given: str) -> str:
    """CTEs that share the budget of each parent among its children."""
    parents = keys[:-1]
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    before = f"({over} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    budget = f"JOIN {given} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {given}"
    k = ", ".join(keys)
    return f"""
{level}_c AS (SELECT {k}, cap, weight, budget FROM (SELECT {k}, sum(cap) AS cap, {_weight(level)} AS weight FROM leaves GROUP BY {k}) {budget}),
{level}_r AS (SELECT *, row_number() OVER ({over} ORDER BY cap / weight, {level}) AS place,
  (budget - coalesce(sum(cap) OVER {before}, 0.0)) / (sum(weight) OVER ({over}) - coalesce(sum(weight) OVER {before}, 0.0)) AS rate FROM {level}_c),
{level}_s AS (SELECT *, min(CASE WHEN cap > rate * weight THEN place END) OVER ({over}) AS short FROM {level}_r),
{level}_t AS (SELECT *, max(CASE WHEN place = short THEN rate END) OVER ({over}) AS final_rate FROM {level}_s),
{level}_b AS (SELECT {k}, CASE WHEN short IS NULL OR place < short THEN cap ELSE floor(final_rate * weight) END AS budget FROM {level}_t)"""


def mixing_sql() -> str:
    return f"""WITH docs AS (SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {EPOCHS} AS cap FROM docs GROUP BY ALL),
whole AS (SELECT floor(sum(tokens) * {PERCENT} / 100) AS budget FROM leaves),{_share("domain", ["domain"], "whole")},{_share("lang", ["domain", "lang"], "domain_b")},{_share("source", ["domain", "lang", "source"], "lang_b")},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS BIGINT) ELSE 1 END AS whole_epochs FROM leaves JOIN source_b USING (domain, lang, source)),
rest AS (SELECT domain, lang, source, whole_epochs, CASE WHEN tokens > 0 THEN CAST(budget - whole_epochs * tokens AS BIGINT) ELSE 0 END AS rest FROM plan),
keyed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole_epochs || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM docs JOIN rest USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(unnest(generate_series(0, whole_epochs - 1 + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM keyed"""


#: Components of links (u, v) given both ways: what each node reaches, and the smallest of it.
REACH = """reach AS (SELECT DISTINCT u, u AS v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
found AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)"""


def lattice_sql() -> str:
    return f"""WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (SELECT vec_id, label, x FROM vectors WHERE label IS NOT NULL AND len(x) > 0 AND list_count(x) = len(x)
  AND len(list_filter(x, lambda c: NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
{REACH},
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN counts ON vec_id = counts.u LEFT JOIN found ON vec_id = found.u"""


def minhash_sql() -> str:
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tokens AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT doc_id, n, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM tokens WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
every AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS shingle FROM runs WHERE c IS NOT NULL OR (n < 3 AND i = 1)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM every GROUP BY doc_id),
shingles AS MATERIALIZED (SELECT doc_id, n, shingle FROM every JOIN sizes USING (doc_id)),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
{REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN found ON doc_id = found.u"""


def lexical_sql() -> str:
    terms = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {terms} FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


def suffixes_sql() -> str:
    return """WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS p FROM raw),
windows AS (SELECT doc_id, p, b[p:p + 199] AS w FROM starts JOIN raw USING (doc_id)),
twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, p FROM windows SEMI JOIN twice USING (w)),
fresh AS (SELECT *, CASE WHEN p > lag(p) OVER d + 200 OR lag(p) OVER d IS NULL THEN 1 ELSE 0 END AS f FROM hits WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, run, min(p) AS s, max(p) + 200 AS e FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM fresh) GROUP BY ALL),
parts AS (SELECT doc_id, s, b[coalesce(lag(e) OVER d, 1):s - 1] AS part FROM runs JOIN raw USING (doc_id) WINDOW d AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, 9223372036854775807, b[max(e):] FROM runs JOIN raw USING (doc_id) GROUP BY doc_id, b),
kept AS (SELECT doc_id, unhex(string_agg(hex(part), '' ORDER BY s)) AS kept FROM parts GROUP BY 1),
sums AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256 FROM raw LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def dialogue_sql() -> str:
    """The cheapest repair row by row in a recursive query: insertions, then what happens to the row."""
    return r"""WITH RECURSIVE src AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS ck, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(ck || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS code FROM src),
changed AS (SELECT ck, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text) AS pos FROM changed),
judged AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows AS (SELECT *, coalesce(lag(initial) OVER (PARTITION BY ck ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM judged),
facts AS (SELECT ck, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM rows GROUP BY 1),
adds(g, label, lines, h, cost) AS (VALUES (0, '', CAST([] AS VARCHAR[]), 0, 0), (1, '', [], 1, 0), (2, '', [], 2, 0), (3, '', [], 3, 0), (0, 'I', ['user:'], 2, 2), (1, 'I', ['user:'], 2, 2), (2, 'I', ['assistant:'], 3, 2), (3, 'I', ['user:'], 2, 2), (0, 'II', ['user:', 'assistant:'], 3, 4), (1, 'II', ['user:', 'assistant:'], 3, 4)),
goes(h, initial, k) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
turned(h, role, k) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
every AS (SELECT ck, pos, h, h AS k, 'D' AS label, 3 AS cost, CAST([] AS VARCHAR[]) AS lines FROM rows, turned
  UNION ALL SELECT ck, pos, h, k, 'K', CAST(fault = 'truncated' AS INTEGER), [role || ':' || text] FROM rows JOIN goes USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT ck, pos, h, k, 'R', 2 + CAST(fault = 'truncated' AS INTEGER), [t.role || ':' || text] FROM rows, turned t WHERE fault NOT IN ('blank', 'duplicate')),
paths AS (SELECT ck, CAST(0 AS BIGINT) AS pos, 0 AS g, 0 AS cost, '' AS labels, CAST([] AS VARCHAR[]) AS lines FROM facts
  UNION ALL SELECT ck, pos, g, cost, labels, lines FROM (SELECT p.ck, p.pos + 1 AS pos, e.k AS g, p.cost + a.cost + e.cost AS cost, p.labels || a.label || e.label AS labels, list_concat(list_concat(p.lines, a.lines), e.lines) AS lines,
    row_number() OVER (PARTITION BY p.ck, e.k ORDER BY p.cost + a.cost + e.cost, p.labels || a.label || e.label) AS place
    FROM paths p JOIN adds a ON a.g = p.g JOIN every e ON e.ck = p.ck AND e.pos = p.pos + 1 AND e.h = a.h) WHERE place = 1),
ends AS (SELECT ck, cost, labels, lines FROM (SELECT p.ck, p.cost + a.cost AS cost, p.labels || a.label AS labels, list_concat(p.lines, a.lines) AS lines, row_number() OVER (PARTITION BY p.ck ORDER BY p.cost + a.cost, p.labels || a.label) AS place
  FROM paths p JOIN facts f ON f.ck = p.ck AND f.n = p.pos JOIN adds a ON a.g = p.g WHERE a.h IN (0, 3)) WHERE place = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(labels, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM src) LEFT JOIN facts USING (ck) LEFT JOIN ends USING (ck)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_lattice": lattice_sql(), "op9_minhash": minhash_sql(), "op10_mixing": mixing_sql(), "op11_lexical": lexical_sql(), "op12_suffixes": suffixes_sql(), "op13_dialogue": dialogue_sql()}

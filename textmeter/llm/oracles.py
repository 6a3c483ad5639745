"""SQL counterparts of the corpus queries, where SQL can express them.

Not here: the graph search (approximate), SimHash and window fingerprints
(XXH64), byte-pair encoding, and fitted models; those have brute-force tests.
"""

from __future__ import annotations

from textmeter.llm.queries import URL_RULES

ORACLES: dict[str, str] = {}


# --- shards ------------------------------------------------------------------

# CRC-32, byte by byte, over a table made by its rule (the reflected polynomial 0xEDB88320).
_CRC = """bits(b, c, k) AS (SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) t(i)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""
_TEXT_CRC = """CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
    regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
    lambda a, b: xor(a >> 8, list_extract(t, CAST((xor(a, b) & 255) + 1 AS BIGINT)))), 4294967295::UBIGINT) AS BIGINT)"""

ORACLES["op3_stratified_shards"] = f"""WITH RECURSIVE {_CRC},
narrow AS (SELECT doc_id, coalesce('=' || source, 'null') AS stratum, CAST(doc_id AS VARCHAR) AS name,
    CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, {_TEXT_CRC} AS text_crc32,
    CAST('0x' || substr(md5('42|' || doc_id), 1, 15) AS BIGINT) AS o FROM documents, crc_table),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY o, name) - CAST(0.5 AS DOUBLE))
    / count(*) OVER (PARTITION BY stratum) AS fraction, count(*) OVER () AS n FROM narrow),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, o, name) - 1 AS p FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((p * 40) // n AS INTEGER) AS shard,
    CAST(p - (((p * 40) // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""


# --- lines -------------------------------------------------------------------

_SENTENCE = "'[^.!?…。！？]*[.!?…。！？]+|[^.!?…。！？]+'"
_WORDS = r"'[\p{L}\p{N}_]+'"
ORACLES["op4_line_dedup"] = rf"""WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM split),
placed AS (SELECT *, regexp_extract_all(line, {_WORDS}) AS words, regexp_extract_all(line, {_SENTENCE}) AS parts,
    CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start FROM lines),
cut AS (SELECT doc_id, i, len(words) AS n, start AS line_start, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS j FROM placed),
sentences AS (SELECT doc_id, i, j, n, part, regexp_extract_all(part, {_WORDS}) AS words,
    CAST(line_start + sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(part) AS BIGINT) AS start FROM cut),
units AS (SELECT doc_id, i, 0 AS j, start, start + length(line) AS stop, lower(array_to_string(words, ' ')) AS unit, len(words) >= 1 AS counts FROM placed
    UNION ALL SELECT doc_id, i, j, start, start + length(part), lower(array_to_string(words, ' ')), len(words) >= 5 AND len(words) < n FROM sentences),
judged AS (SELECT *, counts AND rank() OVER (PARTITION BY counts, unit ORDER BY doc_id, start) > 1 AS again FROM units),
lost AS (SELECT *, again AND (j = 0 OR NOT max(CASE WHEN j = 0 THEN again END) OVER (PARTITION BY doc_id, i)) AS goes,
    max(CASE WHEN j = 0 THEN again END) OVER (PARTITION BY doc_id, i) AS line_goes FROM judged),
pieces AS (SELECT l.doc_id, l.i, l.line_goes OR (count(*) FILTER (l.j > 0) > 0 AND bool_and(l.goes) FILTER (l.j > 0)) AS gone,
    coalesce(string_agg(s.part, '' ORDER BY l.j) FILTER (NOT l.goes), '') AS line
    FROM lost l LEFT JOIN sentences s ON l.doc_id = s.doc_id AND l.i = s.i AND l.j = s.j GROUP BY l.doc_id, l.i, l.line_goes),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text FROM pieces GROUP BY doc_id),
spans AS (SELECT doc_id, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM lost WHERE goes GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text, coalesce(p.removed, '') AS removed
FROM documents d LEFT JOIN joined j USING (doc_id) LEFT JOIN spans p USING (doc_id)"""


# --- urls --------------------------------------------------------------------

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _after(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_after(url)}, '^[^/?#]*', 0), {_UPPER}, {_LOWER})"


def _path(url: str) -> str:
    return f"regexp_extract({_after(url)}, '^[^/?#]*([^?#]*)', 1)"


def _rule(host: str, path: str, what: str) -> str:
    cases = []
    for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.action)):
        value = r.name if what == "name" else r.action
        cases.append(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{value}'")
    return f"CASE {' '.join(cases)} END"


def _address(url: str) -> str:
    whole = f"regexp_extract({url}, '^([^#]*)', 1)"
    head = f"regexp_extract({whole}, '^[^:/?#]*://[^/?]*', 0)"
    rest = f"substr({whole}, length({head}) + 1)"
    path = f"regexp_extract({rest}, '^[^?]*', 0)"
    steps = rf"string_split(regexp_replace({path}, '(/\.\.?)$', '\1/'), '/')[2:]"
    taken = (f"list_reduce(list_transform({steps}, lambda s: [s]), lambda a, x: CASE WHEN x[1] = '..' THEN a[:-2] "
             "WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[]))")
    walked = f"'/' || array_to_string({taken}, '/') || substr({rest}, length({path}) + 1)"
    return rf"translate({head}, {_UPPER}, {_LOWER}) || CASE WHEN regexp_matches({path}, '/\.\.?(/|$)') THEN {walked} ELSE {rest} END"


_CANONICAL = r"""replace(regexp_extract(unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|''[^''>]*\bcanonical\b|canonical\b)[^>]*>')),
    '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&')"""
_REFRESH = r"""replace(regexp_extract(unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')),
    '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&')"""

ORACLES["op9_url_equivalence"] = f"""WITH RECURSIVE
named AS (SELECT url, {_CANONICAL} AS link FROM pages UNION ALL SELECT url, {_REFRESH} FROM pages),
parts AS (SELECT *, regexp_extract(url, '^([^:/?#]*:)//', 1) AS scheme, regexp_extract(url, '^[^:/?#]*://[^/?#]*', 0) AS site,
    regexp_extract(url, '^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM named WHERE link <> '' AND NOT starts_with(link, '#')),
whole AS (SELECT {_address('url')} AS a, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN scheme || link
    WHEN starts_with(link, '/') THEN site || link WHEN ends_with(folder, '/') THEN folder || link ELSE folder || '/' || link END AS target
    FROM parts WHERE site <> '' AND contains(url, '://')),
edges AS (SELECT DISTINCT a, {_address('target')} AS b FROM whole),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT a, a FROM both_ways
    UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
groups AS (SELECT node, min(other) AS alias_of, bool_or(coalesce({_rule(_host('other'), _path('other'), 'action')} = 'allow', false)) AS allowed,
    bool_or(coalesce({_rule(_host('other'), _path('other'), 'action')} = 'block', false)) AS blocked FROM reach GROUP BY node),
read AS (SELECT page_id, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path,
    CASE WHEN contains(url, '://') THEN {_address('url')} END AS address FROM pages)
SELECT page_id, host, path, {_rule('host', 'path', 'name')} AS rule,
    coalesce({_rule('host', 'path', 'action')}, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, alias_of
FROM read LEFT JOIN groups ON node = address"""


# --- ranked search -----------------------------------------------------------

def _terms(text: str) -> str:
    # RE2 reads characters: what is beyond ASCII is a term's, as are its letters and digits.
    return rf"regexp_extract_all(translate(coalesce({text}, ''), {_UPPER}, {_LOWER}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


ORACLES["op13_presence_masks"] = f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_terms('text')} AS terms FROM documents),
asked AS (SELECT i, item_id, unnest(list_distinct(terms)) AS term FROM
    (SELECT item_id, row_number() OVER () AS i, {_terms('text')} AS terms FROM benchmark)),
corpus AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM docs WHERE len(terms) > 0),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(c.docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM held, corpus c GROUP BY term),
mass AS (SELECT r, doc_id, 100 - 50 + ((50 * len(terms) * c.docs) // c.words) AS m FROM docs, corpus c WHERE len(terms) > 0),
scores AS (SELECT i, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN mass USING (r) GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""

"""The queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from liftpanel.llm.fast_sketches import PERCENT, SHINGLE
from liftpanel.llm.fmindex_substrings import WINDOW
from liftpanel.llm.merkle_manifest import TAMPER_MODULUS
from liftpanel.llm.parsed_collocations import LEAST, LONGEST, LOWER, TOP, UNKNOWN, UPPER
from liftpanel.llm.risk_quality import CUTOFFS, LEAST_WORDS, LEVEL, REPEAT_PERCENT, RISK, RULES, SYMBOLS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATED_PASSAGES = f"""
    WITH texts AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    windows AS (
        SELECT doc_id, j, array_to_string(ws[j:j + {WINDOW - 1}], ' ') AS words
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS j FROM texts WHERE len(ws) >= {WINDOW})),
    first AS (SELECT words, min(doc_id) AS least FROM windows GROUP BY words),
    gone AS (
        SELECT DISTINCT doc_id, p
        FROM (SELECT doc_id, unnest(range(j, j + {WINDOW})) AS p FROM windows JOIN first USING (words) WHERE least < doc_id)),
    places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM texts),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words
        FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(words, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)"""

_MEASURES = {
    "symbols": "CAST(floor(1000 * n_symbols / nullif(word_chars, 0)) AS BIGINT)",
    "lines": "CAST(floor(1000 * n_dup_lines / nullif(n_lines, 0)) AS BIGINT)",
    "repeats": "CAST(floor(1000 * n_repeat_words / nullif(n_words, 0)) AS BIGINT)",
    "long_words": "CAST(floor(10 * word_chars / nullif(n_words, 0)) AS BIGINT)",
}
_CHANCE = repr(RISK / len(RULES))

QUALITY = rf"""
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
    lines AS (
        SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM texts),
    windows AS (
        SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
        FROM (SELECT doc_id, j, ws[j] AS a, ws[j + 1] AS b, ws[j + 2] AS c
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS j FROM texts WHERE len(ws) >= 3))),
    repeated AS (
        SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([j, j + 1, j + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
    counts AS (
        SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
               CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
        FROM texts JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
    measured AS (
        SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
               {', '.join(f'{sql} AS {name}' for name, sql in _MEASURES.items())}
        FROM counts),
    good AS (
        SELECT m.* FROM measured m
        JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)
        WHERE NOT base_failed),
    measures AS ({' UNION ALL '.join(f"SELECT stratum, '{x}' AS rule, {x} AS value FROM good WHERE {x} IS NOT NULL" for x in RULES)}),
    tried AS (SELECT unnest({CUTOFFS}) AS cutoff, unnest(range(0, {len(CUTOFFS)})) AS place),
    tests AS (
        SELECT stratum, rule, place, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
        FROM measures, tried GROUP BY ALL),
    shown AS (
        SELECT *, k <= {_CHANCE} * n AND list_sum([
                   exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_CHANCE}) + (n - j) * ln(1 - {_CHANCE}))
                   for j in range(0, k + 1)])
                   <= {LEVEL} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM measured)) AS ok
        FROM tests),
    chosen AS (
        SELECT stratum, rule, min(cutoff) AS cutoff
        FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY place) AS so_far FROM shown)
        WHERE so_far GROUP BY stratum, rule),
    wide AS (
        SELECT m.*, {', '.join(f"(SELECT cutoff FROM chosen c WHERE c.stratum = m.stratum AND c.rule = '{x}') AS {x}_cutoff" for x in RULES)}
        FROM measured m),
    judged AS (
        SELECT *, array_to_string([x for x in [{', '.join(f"CASE WHEN {x} > {x}_cutoff THEN '{x}' END" for x in RULES)}]
                                              if x IS NOT NULL], ',') AS rules
        FROM wide)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND rules = '' AS kept, rules
    FROM judged"""



def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# CRC-32 bit by bit: each byte of the decimal id is a step, and so are the eight shifts after it (negative numbers).
_STEPS = "list_prepend(4294967295, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')]))"
_CRC = f"xor(list_reduce({_STEPS}, lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"

MANIFEST = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS leaf,
               CASE WHEN {_CRC} % {TAMPER_MODULUS} = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS shown,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size
        FROM documents),
    nodes AS (
        SELECT g, 0 AS level, place, size, leaf AS h FROM leaves
        UNION ALL
        SELECT g, any_value(level) + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
        FROM nodes WHERE size > 1 GROUP BY g, place // 2),
    tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
    upper AS (
        SELECT 0 AS level, place, size, h FROM tops
        UNION ALL
        SELECT any_value(level) + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
        FROM upper WHERE size > 1 GROUP BY place // 2),
    climb AS (
        SELECT doc_id, g, 0 AS level, place, size, shown AS h, '' AS siblings FROM leaves
        UNION ALL
        SELECT c.doc_id, c.g, c.level + 1, c.place // 2, (c.size + 1) // 2,
               sha256(CASE WHEN n.h IS NULL THEN c.h WHEN n.place < c.place THEN n.h || c.h ELSE c.h || n.h END), c.siblings || coalesce(n.h, '')
        FROM climb c LEFT JOIN nodes n ON n.g = c.g AND n.level = c.level AND n.place = xor(c.place, 1) WHERE c.size > 1),
    further AS (
        SELECT c.doc_id, 0 AS level, t.place, t.size, c.h, c.siblings FROM climb c JOIN tops t USING (g) WHERE c.size = 1
        UNION ALL
        SELECT c.doc_id, c.level + 1, c.place // 2, (c.size + 1) // 2,
               sha256(CASE WHEN n.h IS NULL THEN c.h WHEN n.place < c.place THEN n.h || c.h ELSE c.h || n.h END), c.siblings || coalesce(n.h, '')
        FROM further c LEFT JOIN upper n ON n.level = c.level AND n.place = xor(c.place, 1) WHERE c.size > 1)
    SELECT l.doc_id, l.leaf, t.h AS subroot, u.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
    FROM leaves l JOIN tops t USING (g) JOIN further f ON f.doc_id = l.doc_id AND f.size = 1 JOIN upper u ON u.size = 1"""

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

COLLOCATIONS = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?
-
]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces),
    grams AS ({' UNION ALL '.join(f"SELECT lang, {k} AS size, unnest([array_to_string(ws[j:j + {k - 1}], ' ') for j in range(1, len(ws) - {k - 2})]) AS phrase FROM words" for k in range(1, LONGEST + 1))}),
    totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
    frequent AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
    free AS (
        SELECT * FROM frequent c
        WHERE size > 1 AND NOT EXISTS (
            SELECT 1 FROM frequent x
            WHERE x.lang = c.lang AND x.size > c.size AND 100 * x.f >= 100 * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (SELECT lang, phrase, f AS a, ws, unnest(range(1, size)) AS k FROM free),
    parts AS (
        SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, CAST(n AS HUGEINT) AS n,
               (CAST(1000 AS HUGEINT) * c.a * CAST(n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM cuts c JOIN totals t ON t.lang = c.lang
        JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
        JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM parts) WHERE nth = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
               ELSE [array_to_string(ws[j:j + {SHINGLE - 1}], ' ') for j in range(1, len(ws) - {SHINGLE - 2})] END) AS s
        FROM texts),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
        WHERE 100 * s.k >= {PERCENT} * (x.n + y.n - s.k)),
    reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    least AS (SELECT a AS doc_id, min(b) AS low FROM reached GROUP BY a)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
           doc_id <= coalesce(low, doc_id) AS kept
    FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""

ORACLES = {
    "op6_risk_quality": QUALITY,
    "op10_fmindex_substrings": REPEATED_PASSAGES,
    "op11_merkle_manifest": MANIFEST,
    "op12_fast_sketches": NEAR_DUPLICATES,
    "op13_parsed_collocations": COLLOCATIONS,
}

"""DuckDB SQL for the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, THRESHOLD, template_rows
from .quality import HOST_RATE, LINES_PERCENT, MIN_WORDS, REPEATED_PERCENT, RULES, STRONGEST, SYMBOLS_PERCENT, Z
from .secrets import ASSIGN_CHARS, BASE, KINDS, SCOPE, WEAK


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _secrets() -> str:
    """Spans of each kind from the running lengths of matches and of what lies between them."""
    kinds = []
    for rank, (kind, pattern) in enumerate({**BASE, **WEAK}.items()):
        right = {
            "assign": f"length(regexp_extract(m[i], '{_quoted(pattern)}', 2)) >= {ASSIGN_CHARS}",
            "key": "regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[0-9]')",
        }.get(kind, "true")
        kinds.append(f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s AS "start", s + length(m[i]) AS "end"
FROM (
  SELECT doc_id, m, i,
         (list_sum(list_transform(b[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{_quoted(pattern)}') AS m, string_split_regex(text, '{_quoted(pattern)}') AS b FROM docs)
        WHERE len(m) > 0)
)
WHERE {right}""")
    near = f'w."start" <= p."end" + {SCOPE} AND w."start" >= p."start" - {SCOPE} AND p.doc_id = w.doc_id'
    names, secret = "('access', 'identifier')", "('assign', 'hex', 'key')"
    has = {k: f"EXISTS (SELECT 1 FROM parts p WHERE p.kind IN {v} AND {near})" for k, v in (("name", names), ("secret", secret))}
    listed = """string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank, "end")"""
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(kinds)}),
spans AS (
  SELECT * FROM parts w WHERE rank < {len(BASE)}
    OR kind = 'key' AND {has["name"]} OR kind = 'identifier' AND {has["secret"]}
    OR kind = 'endpoint' AND {has["name"]} AND {has["secret"]}
),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
         {listed} FILTER (rank < {len(BASE)}) AS base, {listed} AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc_id)
"""


def _hosts() -> str:
    fails = {
        "short": f"n_words < {MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {REPEATED_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {SYMBOLS_PERCENT} * n_words",
        "lines": f"100 * n_dup_lines > {LINES_PERCENT} * n_lines",
    }
    assert tuple(fails) == RULES
    moments = ", ".join(
        f"sum({r}) / sum(n) AS {r}_m, sum({r} * {r} / n) / sum(n) - (sum({r}) / sum(n)) ** 2 "
        f"- sum({r}) / sum(n) * (1 - sum({r}) / sum(n)) * count(*) / sum(n) AS {r}_x"
        for r in RULES
    )
    strength = ", ".join(
        f"CASE WHEN {r}_x > 0 THEN least({STRONGEST}, greatest({r}_m * (1 - {r}_m) / {r}_x - 1, 0.1)) ELSE {STRONGEST} END AS {r}_s" for r in RULES
    )
    rates = ", ".join(f"({r} + {r}_m * {r}_s) / (n + {r}_s) AS {r}_r" for r in RULES)
    bad = " OR ".join(f"{r}_r - {Z} * sqrt({r}_r * (1 - {r}_r) / (n + {r}_s + 1)) > {HOST_RATE}" for r in RULES)
    return rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^ 	-
]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM docs
),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) > 2)
),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM twice) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)
),
hosts AS (
  SELECT source AS host, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER ({v})::DOUBLE AS {k}" for k, v in fails.items())}
  FROM measured GROUP BY source
),
moments AS (SELECT {moments} FROM hosts),
prior AS (SELECT *, {strength} FROM moments),
rates AS (SELECT *, {rates} FROM hosts, prior),
verdicts AS (SELECT host, {bad} AS host_failed FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({fails["short"]} OR {fails["repeats"]}) AS base_failed, host_failed,
       NOT ({fails["short"]} OR {fails["repeats"]} OR host_failed) AS kept
FROM measured JOIN verdicts ON source IS NOT DISTINCT FROM host
"""


def _licenses() -> str:
    """Every block against every template, without any filter."""
    templates = ", ".join(
        f"({r['template']}, '{r['label']}', {r['step']}, {r['needed']}, {r['words']})" for r in template_rows(TEMPLATES, THRESHOLD)
    )
    places = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM tokens WHERE "
        + " AND ".join(f"words[i + {j + 1}] = '{word}'" for j, word in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
tokens AS (SELECT r, words, unnest(range(len(words))) AS i FROM docs),
places AS ({places}),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY r
),
templates(template, label, step, needed, held) AS (VALUES {templates}),
blocks AS (
  SELECT r, step, list_distinct(list_slice(words, b * step + 1, (b + 2) * step)) AS held
  FROM (SELECT r, words, step, unnest(range(greatest(1, CAST(ceil(len(words) / step) AS BIGINT) - 1))) AS b
        FROM docs, (SELECT DISTINCT step FROM templates))
),
matches AS (
  SELECT r, label, len(list_intersect(t.held, b.held)) / len(t.held) AS containment
  FROM blocks b JOIN templates t USING (step) WHERE len(list_intersect(t.held, b.held)) >= needed
),
found AS (SELECT r, list(DISTINCT label) AS found, max(containment) AS score FROM matches GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.found), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(f.found, [])))), ','), '') AS labels,
       coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN base b USING (r) LEFT JOIN found f USING (r)
"""


ORACLES: dict[str, str] = {
    "op3_quality_rules": _hosts(),
    "op6_secret_scan": _secrets(),
    "op7_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS s, words FROM docs WHERE len(words) >= 35
),
windows AS (SELECT doc_id, s, array_to_string(list_slice(words, s, s + 34), ' ') AS w FROM starts),
hits AS (SELECT doc_id, s FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM hits),
removed AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN words
              ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS words
  FROM docs LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
""",
    "op11_license_scan": _licenses(),
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
found AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
),
over AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}

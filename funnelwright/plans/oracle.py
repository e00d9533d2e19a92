"""DuckDB SQL for every named query, written independently of the operators.

All texts start from the same common table expressions over `events`: hits,
facts (one per visit and day), sess (one per visit) and pop (the population).
Figures that end in a sum of floats are rounded as in the catalog.
"""

from __future__ import annotations

from functools import partial

REPS = 1000

BASE = """
WITH gaps AS (
  SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
),
visits AS (
  SELECT *, CAST(SUM(CASE WHEN prev_ts IS NULL OR ts > prev_ts + INTERVAL '12' HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit_ord
  FROM gaps
),
numbered AS (
  SELECT *,
    MIN(event_id) OVER (PARTITION BY user_id, visit_ord) AS "visitId",
    ROW_NUMBER() OVER (PARTITION BY user_id, visit_ord ORDER BY ts, event_id) AS "hitNumber"
  FROM visits
),
hits AS (
  SELECT CAST(user_id AS VARCHAR) AS "fullVisitorId", "visitId", CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
    user_id, visit_ord, "hitNumber",
    CASE WHEN event_type = 'error' THEN 'EVENT' ELSE 'PAGE' END AS type,
    CASE event_type WHEN 'view' THEN '/home' WHEN 'click' THEN '/basket.html'
      WHEN 'signup' THEN '/signin.html' WHEN 'purchase' THEN '/ordercompleted.html' END AS page_path,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'view' THEN '2' WHEN event_type = 'click' THEN '3'
      WHEN event_type = 'signup' THEN '5' WHEN event_type = 'purchase' THEN '6'
      WHEN event_type = 'error' THEN '0' END AS action_type,
    CASE WHEN event_type = 'purchase' THEN 'ORD' || CAST("visitId" AS VARCHAR) END AS tx_id,
    CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0
      THEN CAST(FLOOR(value * 100 + 0.5) AS BIGINT) * 10000 END AS tx_revenue
  FROM numbered
),
grouped AS (
  SELECT "fullVisitorId", "visitId", date, user_id, visit_ord, (user_id * 7 + visit_ord * 11) % 40 AS k,
    COUNT(*) AS n_hits,
    NULLIF(COUNT(*) FILTER (WHERE type = 'PAGE'), 0) AS pageviews,
    NULLIF(COUNT(DISTINCT tx_id), 0) AS transactions,
    MIN(tx_revenue) AS revenue,
    CAST(SUM(tx_revenue) AS BIGINT) AS hit_revenue,
    MAX(CASE WHEN action_type = '2' THEN 1 ELSE 0 END) AS view_raw,
    MAX(CASE WHEN action_type = '3' THEN 1 ELSE 0 END) AS cart_raw,
    MAX(CASE WHEN action_type = '5' THEN 1 ELSE 0 END) AS checkout_raw,
    MAX(CASE WHEN action_type = '6' THEN 1 ELSE 0 END) AS purchase_raw,
    FIRST(page_path ORDER BY "hitNumber") FILTER (WHERE type = 'PAGE') AS landing_page
  FROM hits GROUP BY ALL
),
facts AS (
  SELECT *,
    visit_ord + CASE WHEN user_id % 10 = 0 THEN 3 ELSE 0 END AS "visitNumber",
    CASE WHEN k <= 11 THEN 'Organic Search' WHEN k <= 18 THEN 'Social' WHEN k <= 24 THEN 'Direct'
      WHEN k <= 31 THEN 'Referral' WHEN k <= 33 THEN 'Paid Search' WHEN k = 34 THEN 'Affiliates'
      WHEN k = 35 THEN 'Display' WHEN k <= 37 THEN 'Referral' WHEN k = 38 THEN '(Other)' END AS channel,
    CASE WHEN k <= 6 THEN 'google' WHEN k <= 10 THEN '(direct)' WHEN k = 11 THEN 'bing'
      WHEN k <= 17 THEN 'youtube.com' WHEN k = 18 THEN 'facebook.com' WHEN k <= 28 THEN '(direct)'
      WHEN k = 29 THEN 'google.com' WHEN k = 30 THEN 'qiita.com' WHEN k = 31 THEN NULL
      WHEN k <= 33 THEN 'google' WHEN k = 34 THEN 'Partners' WHEN k = 35 THEN 'dfa'
      WHEN k = 36 THEN 'mail.google.com' WHEN k = 37 THEN 'analytics.google.com' ELSE 'other' END AS source,
    CASE WHEN k <= 6 OR k = 11 THEN 'organic' WHEN k <= 10 THEN '(none)' WHEN k <= 18 THEN 'referral'
      WHEN k <= 28 THEN '(none)' WHEN k <= 31 THEN 'referral' WHEN k <= 33 THEN 'cpc'
      WHEN k = 34 THEN 'affiliate' WHEN k = 35 THEN 'cpm' WHEN k <= 37 THEN 'referral'
      ELSE '(not set)' END AS medium,
    CASE WHEN k BETWEEN 19 AND 24 THEN TRUE
      WHEN (k BETWEEN 7 AND 10 OR k BETWEEN 25 AND 28) AND visit_ord % 2 = 0 THEN TRUE END AS is_true_direct,
    CASE WHEN k BETWEEN 25 AND 27 THEN '/' WHEN k = 28 THEN '/offer/2145' WHEN k = 30 THEN '/r' END AS referral_path,
    CASE WHEN user_id % 10 = 9 THEN 'tablet' WHEN user_id % 10 >= 7 THEN 'mobile' ELSE 'desktop' END AS device,
    CASE WHEN user_id % 30 < 12 THEN 'United States' WHEN user_id % 30 < 17 THEN 'India'
      WHEN user_id % 30 < 21 THEN 'United Kingdom' WHEN user_id % 30 < 24 THEN 'Canada'
      WHEN user_id % 30 < 26 THEN 'Vietnam' WHEN user_id % 30 < 28 THEN 'Germany'
      WHEN user_id % 30 = 28 THEN '(not set)' END AS country,
    CASE WHEN user_id % 9 < 4 THEN '(not set)' WHEN user_id % 9 = 4 THEN 'comcast.net'
      WHEN user_id % 9 = 5 THEN 'verizon.net' WHEN user_id % 9 = 6 THEN 'rr.com'
      WHEN user_id % 9 = 7 THEN 'google.com' END AS net_domain,
    CASE WHEN visit_ord = 1 AND user_id % 10 <> 0 THEN CAST(1 AS BIGINT) END AS new_visits
  FROM grouped
),
sess AS (
  SELECT "fullVisitorId", "visitId", MIN(date) AS date,
    FIRST(channel ORDER BY date) AS channel,
    FIRST(COALESCE(source, '') ORDER BY date) AS source,
    FIRST(COALESCE(medium, '') ORDER BY date) AS medium,
    FIRST(referral_path ORDER BY date) AS referral_path,
    FIRST(device ORDER BY date) AS device,
    FIRST(country ORDER BY date) AS country,
    FIRST(COALESCE(net_domain, '') ORDER BY date) AS net_domain,
    FIRST(new_visits ORDER BY date) AS new_visits,
    MAX("visitNumber") AS visit_number,
    MAX(CASE WHEN is_true_direct THEN 1 ELSE 0 END) AS is_true_direct,
    MAX(CASE WHEN referral_path IS NOT NULL THEN 1 ELSE 0 END) AS has_referral_path,
    CAST(SUM(n_hits) AS BIGINT) AS n_hits,
    MAX(view_raw) AS view_raw, MAX(cart_raw) AS cart_raw,
    MAX(checkout_raw) AS checkout_raw, MAX(purchase_raw) AS purchase_raw,
    CAST(SUM(revenue) AS BIGINT) AS revenue
  FROM facts GROUP BY "fullVisitorId", "visitId"
),
deep AS (
  SELECT *,
    CASE WHEN purchase_raw = 1 THEN 4 WHEN checkout_raw = 1 THEN 3 WHEN cart_raw = 1 THEN 2 ELSE view_raw END AS deepest,
    CASE WHEN view_raw = 0 THEN 0 WHEN cart_raw = 0 THEN 1 WHEN checkout_raw = 0 THEN 2 ELSE 3 + purchase_raw END AS unbroken
  FROM sess
),
flagged AS (
  SELECT *,
    CAST(deepest >= 1 AS INT) AS mono_1, CAST(deepest >= 2 AS INT) AS mono_2,
    CAST(deepest >= 3 AS INT) AS mono_3, CAST(deepest >= 4 AS INT) AS mono_4,
    CAST(unbroken >= 1 AS INT) AS strict_1, CAST(unbroken >= 2 AS INT) AS strict_2,
    CAST(unbroken >= 3 AS INT) AS strict_3, CAST(unbroken >= 4 AS INT) AS strict_4
  FROM deep
),
pop AS (
  SELECT *,
    channel = 'Referral' AND source = '(direct)' AND medium = '(none)' AS hidden
  FROM flagged
  WHERE channel IS NOT NULL AND channel <> '(Other)' AND source NOT LIKE '%.google.com'
)
"""

MONO = """CAST(SUM(mono_1) AS BIGINT) AS viewed_mono, CAST(SUM(mono_2) AS BIGINT) AS cart_mono,
  CAST(SUM(mono_3) AS BIGINT) AS checkout_mono, CAST(SUM(mono_4) AS BIGINT) AS purchase_mono"""
STRICT = """CAST(SUM(strict_1) AS BIGINT) AS viewed_strict, CAST(SUM(strict_2) AS BIGINT) AS cart_strict,
  CAST(SUM(strict_3) AS BIGINT) AS checkout_strict, CAST(SUM(strict_4) AS BIGINT) AS purchase_strict"""
COUNTS = f"COUNT(*) AS sessions, {MONO}, {STRICT}"


def cte(*parts: str) -> str:
    """Base tables, further named tables, and the final SELECT (last part)."""
    *tables, final = parts
    return BASE + "".join(f", {t}\n" for t in tables) + final


def pct(a: str, b: str) -> str:
    return f"(1e2 * ({a}) / NULLIF({b}, 0))"


def big(text: str) -> str:
    return f"CAST({text} AS BIGINT)"


def rolled(group: str, counts: str, source: str = "pop") -> str:
    return f"""SELECT CASE WHEN GROUPING(t.{group}) = 1 THEN 'ALL' ELSE t.{group} END AS {group}, {counts}
FROM {source} t GROUP BY ROLLUP(t.{group})"""


CHANNEL_FUNNEL = "f AS (" + rolled("channel", COUNTS) + ")"
DEVICE_FUNNEL = "f AS (" + rolled("device", COUNTS) + ")"
TYPED = """typed AS (SELECT *, CASE WHEN COALESCE(new_visits, 0) = 1 THEN 'new' ELSE 'returning' END AS visitor_type
FROM pop)"""
TYPE_FUNNEL = "f AS (" + rolled("visitor_type", f"COUNT(*) AS sessions, {MONO}", "typed") + ")"


def long_of(group: str, versions: tuple[str, ...] = ("mono", "strict"), keys: str = "", source: str = "f") -> str:
    """Table `l`: one line per group, version and step of funnel table `source`."""
    parts = []
    for v in versions:
        before = "sessions"
        for no, step in enumerate(("viewed", "cart", "checkout", "purchase"), start=1):
            parts.append(
                f"SELECT {keys}{group}, '{v}' AS version, '{step}' AS step, {no} AS step_no, sessions, "
                f"{step}_{v} AS n, {before} AS prev_n FROM {source}"
            )
            before = f"{step}_{v}"
    union = "\nUNION ALL ".join(parts)
    return f"""l AS (SELECT *, {pct("n", "prev_n")} AS cr_step, {pct("n", "sessions")} AS cr_overall
FROM ({union}))"""


TX = """tx AS (
  SELECT tx_id, COUNT(*) AS hit_rows, COUNT(DISTINCT "fullVisitorId" || '-' || CAST("visitId" AS VARCHAR)) AS in_sessions,
    COUNT(tx_revenue) AS rev_hits, CAST(SUM(tx_revenue) AS BIGINT) AS revenue
  FROM hits WHERE tx_id IS NOT NULL GROUP BY tx_id)"""
STEPS_BY_SESSION = """steps AS (
  SELECT "fullVisitorId", "visitId",
    MAX(CASE WHEN action_type = '2' THEN 1 ELSE 0 END) AS view_raw,
    MAX(CASE WHEN action_type = '3' THEN 1 ELSE 0 END) AS cart_raw,
    MAX(CASE WHEN action_type = '5' THEN 1 ELSE 0 END) AS checkout_raw,
    MAX(CASE WHEN action_type = '6' THEN 1 ELSE 0 END) AS purchase_raw
  FROM hits GROUP BY "fullVisitorId", "visitId")"""
GAPS = f"""g AS (SELECT COUNT(*) FILTER (WHERE purchase_raw = 1) AS purchase_sessions,
  COUNT(*) FILTER (WHERE purchase_raw = 1 AND view_raw = 0) AS purchase_without_view,
  COUNT(*) FILTER (WHERE purchase_raw = 1 AND cart_raw = 0) AS purchase_without_cart,
  COUNT(*) FILTER (WHERE purchase_raw = 1 AND checkout_raw = 0) AS purchase_without_checkout FROM steps)"""


def nth(percent: int) -> str:
    return f"""(SELECT revenue FROM ranked WHERE rn = (n * {percent} + 99) // 100) / 1e6"""


RANKED = """ranked AS (SELECT revenue, ROW_NUMBER() OVER (ORDER BY revenue) AS rn, COUNT(*) OVER () AS n
  FROM facts WHERE revenue IS NOT NULL)"""
REVENUE = f"""rev AS (SELECT COUNT(*) AS sessions, COUNT(*) FILTER (WHERE revenue IS NULL) AS revenue_null,
  COUNT(*) FILTER (WHERE revenue = 0) AS revenue_zero, COUNT(*) FILTER (WHERE revenue < 0) AS revenue_negative,
  MIN(revenue) / 1e6 AS min_usd, {nth(50)} AS p50_usd, {nth(95)} AS p95_usd, {nth(99)} AS p99_usd,
  MAX(revenue) / 1e6 AS max_usd FROM facts)"""
TRUTH = """t AS (SELECT CAST(SUM(revenue) AS BIGINT) / 1e6 AS session_level_usd,
  CAST(SUM(hit_revenue) AS BIGINT) / 1e6 AS hit_level_usd FROM facts)"""
UNKNOWN = "(channel IS NULL OR channel = '(Other)')"
KEYS = """keys AS (SELECT COUNT(*) AS rows_total,
  COUNT(DISTINCT "fullVisitorId" || '-' || CAST("visitId" AS VARCHAR)) AS key_2,
  COUNT(DISTINCT "fullVisitorId" || '-' || CAST("visitId" AS VARCHAR) || '-' || date) AS key_3,
  COUNT(DISTINCT "fullVisitorId") AS visitors FROM facts)"""
INTERNAL = """internal AS (SELECT source, medium, COUNT(*) AS sessions,
  COUNT(*) FILTER (WHERE transactions IS NOT NULL) AS purchase_sessions
  FROM facts WHERE source LIKE '%.google.com' GROUP BY source, medium)"""
EXCLUSIONS = f"""x AS (SELECT COUNT(*) AS sessions_all, COUNT(*) FILTER (WHERE {UNKNOWN}) AS excl_no_channel,
  COUNT(*) FILTER (WHERE source LIKE '%.google.com') AS excl_internal_google,
  COUNT(*) FILTER (WHERE {UNKNOWN} AND source LIKE '%.google.com') AS excl_overlap,
  COUNT(*) FILTER (WHERE NOT {UNKNOWN} AND source NOT LIKE '%.google.com') AS sessions_kept FROM sess)"""


def confound(group: str) -> str:
    counts = f"""COUNT(*) FILTER (WHERE n_hits > 0) AS sessions_with_hits,
  COUNT(*) FILTER (WHERE n_hits > 0 AND view_raw = 0) AS no_view_event,
  {pct("COUNT(*) FILTER (WHERE n_hits > 0 AND view_raw = 0)", "COUNT(*) FILTER (WHERE n_hits > 0)")} AS pct_no_view,
  COUNT(*) FILTER (WHERE purchase_raw = 1) AS purchase_sessions,
  COUNT(*) FILTER (WHERE purchase_raw = 1 AND view_raw = 0) AS buyers_no_view,
  {pct("COUNT(*) FILTER (WHERE purchase_raw = 1 AND view_raw = 0)", "COUNT(*) FILTER (WHERE purchase_raw = 1)")}
    AS pct_buyers_no_view"""
    return rolled(group, counts)


BY_ORIGIN = f"""o AS (SELECT channel,
  CASE WHEN source = '(direct)' AND medium = '(none)' THEN 'hidden_direct' ELSE 'raw_source' END AS bucket,
  COUNT(*) AS sessions, {big("SUM(GREATEST(view_raw, purchase_raw))")} AS viewed_or_purchased,
  {big("SUM(purchase_raw)")} AS purchases, {pct("SUM(purchase_raw)", "COUNT(*)")} AS cr_pct
  FROM pop GROUP BY 1, 2 HAVING COUNT(*) >= 100)"""
GRP = "CASE WHEN hidden THEN 'hidden_direct' ELSE 'rest' END"
CROSS = f"""c AS (SELECT channel, device, COUNT(*) AS sessions, {big("SUM(view_raw)")} AS viewed_strict,
  {big("SUM(purchase_raw)")} AS purchase_mono, {pct("SUM(purchase_raw)", "COUNT(*)")} AS cr_pct
  FROM pop GROUP BY channel, device)"""
COUNTRIES = f"""f AS (SELECT country, COUNT(*) AS sessions, {MONO} FROM pop
  WHERE country IN (SELECT country FROM pop GROUP BY country ORDER BY COUNT(*) DESC, country NULLS FIRST LIMIT 5)
  GROUP BY country)"""
VARIANTS = """vp AS (
  SELECT 'all' AS variant, * FROM pop
  UNION ALL SELECT 'no_social', * FROM pop WHERE channel <> 'Social'
  UNION ALL SELECT 'no_hidden_referral', * FROM pop WHERE NOT hidden
  UNION ALL SELECT 'no_both', * FROM pop WHERE channel <> 'Social' AND NOT hidden)"""
VARIANT_FUNNEL = f"f AS (SELECT variant, device, {COUNTS} FROM vp GROUP BY variant, device)"
SENSITIVITY = """sp AS (
  SELECT 'all' AS variant, * FROM pop
  UNION ALL SELECT 'no_hidden_referral', * FROM pop WHERE NOT hidden
  UNION ALL SELECT 'no_internal_network', * FROM pop WHERE net_domain <> 'google.com')"""


def gap_of(group: str, a: str, b: str, keys: str = "") -> str:
    return f"""gp AS (SELECT {keys}version, step, step_no, a.cr_step AS cr_a, b.cr_step AS cr_b,
  a.cr_step - b.cr_step AS gap_pp, a.cr_step / NULLIF(b.cr_step, 0) AS ratio
  FROM (SELECT * FROM l WHERE {group} = '{a}') a JOIN (SELECT * FROM l WHERE {group} = '{b}') b
  USING ({keys}version, step, step_no))"""


GAP_FINAL = """SELECT version, step, cr_a, cr_b, gap_pp, ratio,
  gap_pp = MAX(gap_pp) OVER (PARTITION BY version) AS largest,
  gap_pp = MIN(gap_pp) OVER (PARTITION BY version) AS smallest FROM gp"""


# ---- statistics ------------------------------------------------------------

def chi_of(cells: str, keys: str, entered: str, passed: str) -> str:
    """Table `chi`: chi-square of an r x 2 table, from observed and expected counts."""
    return f"""expect AS (SELECT *, SUM({passed}) OVER w / NULLIF(SUM({entered}) OVER w, 0) AS p0
  FROM {cells} WINDOW w AS (PARTITION BY {keys})),
chi AS (SELECT {keys}, COUNT(*) AS groups, CAST(SUM({entered}) AS BIGINT) AS n, COUNT(*) - 1 AS df,
  SUM(({passed} - {entered} * p0) ** 2 / NULLIF({entered} * p0, 0)
    + ({entered} * p0 - {passed}) ** 2 / NULLIF({entered} * (1 - p0), 0)) AS chi2
  FROM expect GROUP BY {keys})"""


def tail(chi2: str, df: str) -> str:
    """Upper tail of chi-square, as one minus the power series of the lower gamma."""
    x, s = f"({chi2} / 2)", f"({df} / 2.0)"
    series = (
        f"LIST_SUM(LIST_TRANSFORM(RANGE(0, 2000), lambda i: EXP(({s} + i) * LN({x}) - {x} - LGAMMA({s} + i + 1))))"
    )
    return f"CASE WHEN {chi2} <= 0 THEN 1e0 ELSE 1 - {series} END"


def holm(p: str, keys: str, source: str) -> str:
    """Table `hp`: Holm steps within a family."""
    return f"""hp0 AS (SELECT *, {p} * (COUNT({p}) OVER (PARTITION BY {keys})
    - ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {p} NULLS LAST, step_no) + 1) AS scaled FROM {source}),
hp AS (SELECT *, CASE WHEN {p} IS NOT NULL THEN LEAST(1e0, MAX(scaled) OVER (PARTITION BY {keys}
    ORDER BY {p} NULLS LAST, step_no ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM hp0)"""


TESTED = "cells AS (SELECT * FROM l WHERE channel <> 'ALL' AND prev_n >= 100)"
CHI = [
    CHANNEL_FUNNEL, long_of("channel"), TESTED, chi_of("cells", "version, step, step_no", "prev_n", "n"),
    f"tests AS (SELECT *, CASE WHEN df >= 1 THEN {tail('chi2', 'df')} END AS p_value, "
    "CASE WHEN df >= 1 THEN SQRT(chi2 / n) END AS cramers_v FROM chi)",
]

def people_of(source: str = "pop", x: str = "") -> str:
    """Tables `chan` and `person`: purchases per visitor and channel, and the visitor's first session."""
    return f"""chan{x} AS (
  SELECT "fullVisitorId", channel, COUNT(*) AS n, CAST(SUM(purchase_raw) AS BIGINT) AS purchases
  FROM {source} GROUP BY "fullVisitorId", channel),
person{x} AS (
  SELECT "fullVisitorId", FIRST(channel ORDER BY visit_number, "visitId") AS first_channel,
    FIRST(visit_number ORDER BY visit_number, "visitId") AS first_visit_number,
    MIN(date) AS first_date, MIN(date) FILTER (WHERE purchase_raw = 1) AS first_purchase,
    COUNT(*) AS sessions, CAST(SUM(purchase_raw) AS BIGINT) AS purchases
  FROM {source} GROUP BY "fullVisitorId")"""


PEOPLE = people_of()


def shift_of(keep: str = "TRUE", x: str = "", people: str = "") -> str:
    """Table `sh`: both rankings over the visitors that satisfy `keep`."""
    return f"""kept{x} AS (SELECT * FROM person{people} WHERE {keep}),
last_c{x} AS (SELECT channel, SUM(c.purchases) AS k FROM chan{people} c JOIN kept{x} USING ("fullVisitorId")
  GROUP BY channel HAVING SUM(c.purchases) > 0),
first_c{x} AS (SELECT first_channel AS channel, SUM(purchases) AS k FROM kept{x}
  GROUP BY first_channel HAVING SUM(purchases) > 0),
both_c{x} AS (SELECT channel, {big("COALESCE(l.k, 0)")} AS last_click, {big("COALESCE(f.k, 0)")} AS first_touch
  FROM last_c{x} l FULL JOIN first_c{x} f USING (channel)),
sh{x} AS (SELECT channel, last_click, first_touch, RANK() OVER (ORDER BY last_click DESC) AS last_click_rank,
  RANK() OVER (ORDER BY first_touch DESC) AS first_touch_rank,
  RANK() OVER (ORDER BY last_click DESC) - RANK() OVER (ORDER BY first_touch DESC) AS shift FROM both_c{x})"""


def stacked(names: list[str], key: str = "variant") -> str:
    """Table `shifts`: the numbered `sh` tables under their names."""
    parts = [f"SELECT '{name}' AS {key}, * FROM sh{i}" for i, name in enumerate(names)]
    return "shifts AS (" + " UNION ALL ".join(parts) + ")"


SENSITIVE = {"all": "TRUE", "no_hidden_referral": "NOT hidden", "no_internal_network": "net_domain <> 'google.com'"}
SENSITIVE_SHIFTS = [
    *[
        f"pop{i} AS (SELECT * FROM pop WHERE {keep}), {people_of(f'pop{i}', str(i))}, {shift_of('TRUE', str(i), str(i))}"
        for i, keep in enumerate(SENSITIVE.values())
    ],
    stacked(list(SENSITIVE)),
]
DAYS = """days AS (SELECT DATE_DIFF('day', CAST(first_date AS DATE), CAST(first_purchase AS DATE)) AS d
  FROM person WHERE first_purchase IS NOT NULL),
days_n AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS rn, COUNT(*) OVER () AS n FROM days),
horizon AS (SELECT d AS horizon_days FROM days_n WHERE rn = (n * 90 + 99) // 100),
window_end AS (SELECT MAX(date) AS last_day FROM pop)"""
# The first session in the window, over all sessions and not the analysed ones alone, is the first ever.
UNTRUNCATED = """"fullVisitorId" IN (SELECT "fullVisitorId" FROM sess GROUP BY 1 HAVING MIN(visit_number) <= 1)"""
SEEN = """DATE_DIFF('day', CAST(first_date AS DATE), CAST((SELECT last_day FROM window_end) AS DATE))
  >= (SELECT horizon_days FROM horizon)"""


def spearman_of(source: str, keys: str = "") -> str:
    """Table `rho`: correlation of tie-averaged ranks."""
    part = f"PARTITION BY {keys}" if keys else ""
    same = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""rk AS (SELECT {lead}RANK() OVER ({part} ORDER BY last_click DESC)
    + (COUNT(*) OVER ({same}last_click) - 1) / 2e0 AS ra,
  RANK() OVER ({part} ORDER BY first_touch DESC) + (COUNT(*) OVER ({same}first_touch) - 1) / 2e0 AS rb FROM {source}),
rho AS (SELECT {lead}COUNT(*) AS n, CASE WHEN STDDEV_POP(ra) > 0 AND STDDEV_POP(rb) > 0 THEN CORR(ra, rb) END AS rho
  FROM rk {group})"""


# Draws: the same hash and the same inversion as a table of distribution functions.
DRAWS = f"""reps AS (SELECT UNNEST(RANGE(0, {REPS + 1})) AS rep),
keyed AS (SELECT pat.*, rep, MD5('1|' || CAST(rep AS VARCHAR) || '|' || MD5(pattern)) AS h FROM pat, reps),
drawn0 AS (SELECT *, CAST(('0x' || SUBSTR(h, 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS u FROM keyed),
rates AS (SELECT DISTINCT m, CAST(GREATEST(0, FLOOR(m - 12 * SQRT(m))) AS BIGINT) AS low FROM pat),
pmf AS (SELECT m, k, EXP(k * LN(m) - m - LGAMMA(k + 1)) AS p
  FROM rates, LATERAL (SELECT UNNEST(RANGE(low, CAST(CEIL(m + 10 * SQRT(m) + 15) AS BIGINT))) AS k)),
cdf AS (SELECT m, k, SUM(p) OVER (PARTITION BY m ORDER BY k) AS c FROM pmf),
cdfs AS (SELECT m, MIN(k) AS low, LIST(c ORDER BY k) AS cs FROM cdf GROUP BY m),
drawn AS (SELECT d.* EXCLUDE (u, h), CASE WHEN rep = 0 THEN d.m ELSE low + LEN(LIST_FILTER(cs, lambda c: c <= u)) END AS w
  FROM drawn0 d JOIN cdfs USING (m))"""


def told(*fields: str) -> str:
    """Fields as text that tells them apart: each behind its length, a missing one as a mark."""
    return " || ',' || ".join(f"COALESCE(LENGTH(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields)


def moment_draws(keys: str = "") -> str:
    """Table `md`: totals of each cell (a, b) in each replicate, from `mu` (visitor, a, b, n)."""
    same = f"PARTITION BY {keys.rstrip(', ')} " if keys else ""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    using = "USING (" + keys + '"fullVisitorId")'
    joined = " AND ".join([f"x.{k} = y.{k}" for k in keys.replace(" ", "").split(",") if k] or ["TRUE"])
    lead = "".join(f"x.{k}, " for k in keys.replace(" ", "").split(",") if k)
    return f"""mc AS (SELECT {keys}a, b, SUM(n)::DOUBLE AS total, ROW_NUMBER() OVER ({same}ORDER BY a, b) AS i FROM mu GROUP BY {keys}a, b),
mi AS (SELECT {keys}"fullVisitorId", i, n::DOUBLE AS n FROM mu JOIN mc USING ({keys}a, b)),
mp AS (SELECT {keys}x.i AS i, y.i AS j, SUM(x.n * y.n) AS s FROM mi x JOIN mi y {using} GROUP BY ALL),
mr AS (SELECT {lead}x.i AS i, ANY_VALUE(x.total) AS total, LIST(COALESCE(s, 0) ORDER BY y.i) AS line
  FROM mc x JOIN mc y ON {joined} LEFT JOIN mp ON mp.i = x.i AND mp.j = y.i {"".join(f"AND mp.{k} = x.{k} " for k in keys.replace(" ", "").split(",") if k)}GROUP BY {lead}x.i),
mm AS (SELECT {keys}LIST(total ORDER BY i) AS totals, LIST(line ORDER BY i) AS c FROM mr {group}),
ml AS (
  SELECT {keys}0 AS k, totals, c, CAST([] AS DOUBLE[][]) AS cols FROM mm
  UNION ALL
  SELECT {keys}k + 1, totals, c, LIST_APPEND(cols, LIST_TRANSFORM(rest, lambda v, i:
    CASE WHEN rest[k + 1] > 1e-9 * c[k + 1][k + 1] AND i > k THEN v / SQRT(rest[k + 1]) ELSE 0 END))
  FROM (SELECT *, LIST_TRANSFORM(c[k + 1], lambda v, i:
    v - COALESCE(LIST_SUM(LIST_TRANSFORM(cols, lambda l: l[i] * l[k + 1])), 0)) AS rest FROM ml WHERE k < LEN(c))
),
mz AS (SELECT ml.*, rep, LIST_TRANSFORM(RANGE(LEN(c)), lambda j: MD5('1|' || rep || '|' || j)) AS h
  FROM ml, (SELECT UNNEST(RANGE(0, {REPS + 1})) AS rep) WHERE k = LEN(c)),
mn AS (SELECT *, LIST_TRANSFORM(h, lambda x: SQRT(-2 * LN(1 - CAST(('0x' || SUBSTR(x, 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE))
  * COS(2 * PI() * CAST(('0x' || SUBSTR(x, 9, 8)) AS UBIGINT) / 4294967296.0::DOUBLE)) AS z FROM mz),
mw AS (SELECT {keys}rep, UNNEST(RANGE(1, LEN(c) + 1)) AS i, totals, cols, z FROM mn),
md AS (SELECT {keys}rep, a, b, CASE WHEN rep = 0 THEN total ELSE GREATEST(0, FLOOR(total
    + LIST_SUM(LIST_TRANSFORM(cols, lambda l, j: l[i] * z[j])) + 0.5)) END AS w FROM mw JOIN mc USING ({keys}i))"""


def reach_moments(source: str, group: str, keys: str = "", depth: str = "deepest") -> str:
    """Table `rc` from moments: cells are group and depth."""
    return f"""mu AS (SELECT {keys}"fullVisitorId", {group} AS a, {depth} AS b, COUNT(*) AS n
  FROM {source} GROUP BY ALL),
{moment_draws(keys)},
rg AS (SELECT {keys}rep, a AS g, SUM(w) AS n0, SUM(CASE WHEN b >= 1 THEN w ELSE 0 END) AS n1,
  SUM(CASE WHEN b >= 3 THEN w ELSE 0 END) AS n3, SUM(CASE WHEN b >= 4 THEN w ELSE 0 END) AS n4 FROM md GROUP BY ALL),
{entered_steps(keys)}"""


def credit_moments(keys: str = "") -> str:
    """Table `pc` from moments: cells are channel and rule; `mu` has them."""
    return f"""{moment_draws(keys)},
pc AS (SELECT {keys}rep, a AS channel, SUM(CASE WHEN b = 'last' THEN w ELSE 0 END) AS last_click,
  SUM(CASE WHEN b = 'first' THEN w ELSE 0 END) AS first_touch FROM md GROUP BY ALL)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def reach_draws(source: str, group: str, keys: str = "") -> str:
    """Table `rc`: entered and passed of the first and last step per replicate and group."""
    return f"""unit AS (SELECT {keys}"fullVisitorId", {group} AS g, deepest AS depth,
  COUNT(*) AS n FROM {source} GROUP BY ALL),
person_p AS (SELECT {keys}"fullVisitorId", STRING_AGG({told("g", "depth", "n")}, ',' ORDER BY g, depth, n) AS pattern,
  LIST({{'g': g, 'depth': depth, 'n': n}} ORDER BY g, depth, n) AS items FROM unit GROUP BY {keys}"fullVisitorId"),
pat AS (SELECT {keys}pattern, items, COUNT(*) AS m FROM person_p GROUP BY ALL),
{reached_steps(keys)}"""


def reached_steps(keys: str = "") -> str:
    return f"""{DRAWS},
flat AS (SELECT {keys}rep, w, UNNEST(items) AS i FROM drawn),
rg AS (SELECT {keys}rep, i.g AS g, SUM(w * i.n) AS n0, SUM(CASE WHEN i.depth >= 1 THEN w * i.n ELSE 0 END) AS n1,
  SUM(CASE WHEN i.depth >= 3 THEN w * i.n ELSE 0 END) AS n3, SUM(CASE WHEN i.depth >= 4 THEN w * i.n ELSE 0 END) AS n4
  FROM flat GROUP BY ALL),
{entered_steps(keys)}"""


def entered_steps(keys: str = "") -> str:
    return f"""rs AS (SELECT {keys}rep, g, 'first' AS step, n0 AS entered, n1 AS passed FROM rg
  UNION ALL SELECT {keys}rep, g, 'last', n3, n4 FROM rg),
rc AS (SELECT * FROM rs QUALIFY MAX(CASE WHEN rep = 0 THEN entered END) OVER (PARTITION BY {keys}g, step) >= 100)"""


def interval(source: str, value: str, keys: str = "", verdict: bool = True) -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    low = f"QUANTILE_CONT({value}, 0.025) FILTER (WHERE rep > 0)"
    confirmed = f", {low} > 0 AS confirmed" if verdict else ""
    return f"""SELECT {keys}ROUND(MAX({value}) FILTER (WHERE rep = 0), 9) AS estimate,
  ROUND({low}, 9) AS low, ROUND(QUANTILE_CONT({value}, 0.975) FILTER (WHERE rep > 0), 9) AS high,
  COUNT({value}) FILTER (WHERE rep > 0) AS replicates{confirmed} FROM {source} {group}"""


V_DIFFS = """vs AS (SELECT rep, MAX(CASE WHEN step = 'first' AND df >= 1 THEN SQRT(chi2 / n) END)
  - MAX(CASE WHEN step = 'last' AND df >= 1 THEN SQRT(chi2 / n) END) AS diff FROM chi GROUP BY rep)"""
REVENUE_BY = """SELECT {keys}channel, COUNT(*) AS sessions, CAST(SUM(purchase_raw) AS BIGINT) AS purchase_sessions,
  COUNT(revenue) AS sessions_with_revenue, CAST(SUM(revenue) AS BIGINT) / 1e6 AS revenue_usd,
  CAST(SUM(revenue) FILTER (WHERE purchase_raw = 1) AS BIGINT) / 1e6
    / NULLIF(COUNT(revenue) FILTER (WHERE purchase_raw = 1), 0) AS avg_order_usd,
  CAST(SUM(revenue) AS BIGINT) / 1e6 / COUNT(*) AS revenue_per_session_usd FROM {source} GROUP BY {keys}channel"""


def cv(source: str, keys: str = "") -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    a = "STDDEV_POP(conversion_pct) / AVG(conversion_pct)"
    b = "STDDEV_POP(avg_order_usd) / AVG(avg_order_usd)"
    return cte(
        *([SENSITIVITY] if keys else []),
        "rb AS (" + REVENUE_BY.format(keys=keys, source=source) + ")",
        f"rc AS (SELECT *, {pct('purchase_sessions', 'sessions')} AS conversion_pct FROM rb)",
        f"""SELECT {keys}COUNT(*) AS groups, ROUND({a}, 9) AS cv_conversion, ROUND({b}, 9) AS cv_order_value,
  ROUND(({a}) / ({b}), 9) AS cv_ratio, {a} >= 2 * ({b}) AS confirmed FROM rc {group}""",
    )


K = '"fullVisitorId", "visitId"'
SPREAD_PICK = "FIRST(channel ORDER BY cr_step {}, channel) FILTER (WHERE cr_step IS NOT NULL)"

ORACLES: dict[str, str] = {
    # sources and sinks
    "a01_read_sessions": cte(f"""SELECT date, COUNT(*) AS rows_of_day, {big("SUM(n_hits)")} AS hits_of_day,
  {big("SUM(purchase_raw)")} AS purchase_rows FROM facts WHERE date BETWEEN '2024-01-08' AND '2024-01-21' GROUP BY date"""),
    "a02_read_result": cte(rolled("channel", COUNTS)),
    "a03_read_optional": cte(CROSS, "SELECT * FROM c"),
    "a04_write_result": cte(f"""SELECT channel, COUNT(*) AS sessions, COUNT(*) FILTER (WHERE visit_number > 1) AS
  returning_sessions, {pct("COUNT(*) FILTER (WHERE visit_number > 1)", "COUNT(*)")} AS pct_returning
FROM pop GROUP BY channel"""),
    # shared transformations
    "b01_step_flags": cte(f"SELECT {K}, date, n_hits, view_raw, cart_raw, checkout_raw, purchase_raw FROM facts"),
    "b02_steps_exploded": cte(STEPS_BY_SESSION, "SELECT * FROM steps"),
    "b03_behavioural_sessions": cte("SELECT * FROM sess"),
    "b03b_bucketed_sessions": cte("SELECT * FROM sess"),
    "b04_population": cte(f"SELECT {K}, channel, source FROM pop"),
    "b05_internal_source": cte(f"SELECT {K}, date, source, source LIKE '%.google.com' AS internal FROM facts"),
    "b06_monotone": cte(f"""SELECT {K}, mono_1 AS viewed_mono, mono_2 AS cart_mono, mono_3 AS checkout_mono,
  mono_4 AS purchase_mono FROM pop"""),
    "b07_strict": cte(f"""SELECT {K}, strict_1 AS viewed_strict, strict_2 AS cart_strict, strict_3 AS checkout_strict,
  strict_4 AS purchase_strict FROM pop"""),
    "b08_direct_sourced": cte(f"""SELECT {K}, CASE WHEN source = '(direct)' AND medium = '(none)' THEN 1 ELSE 0 END
  AS direct_sourced FROM sess"""),
    "b09_hidden_direct": cte(f"""SELECT {K}, CASE WHEN channel = 'Referral' AND source = '(direct)' AND medium = '(none)'
  THEN 'hidden_direct' ELSE 'rest' END AS grp FROM sess"""),
    "b10_visitor_type": cte(f"""SELECT {K}, date, CASE WHEN COALESCE(new_visits, 0) = 1 THEN 'new' ELSE 'returning' END
  AS visitor_type FROM facts"""),
    "b11_landing_page": cte(f"SELECT {K}, date, landing_page FROM facts"),
    "b12_normalised_origin": cte(f"""SELECT {K}, date, COALESCE(source, '') AS source, COALESCE(medium, '') AS medium,
  COALESCE(net_domain, '') AS net_domain FROM facts"""),
    "b13_sample_variants": cte(VARIANTS, "SELECT variant, COUNT(*) AS sessions FROM vp GROUP BY variant"),
    "b14_min_cell": cte(CROSS, """SELECT channel, device, sessions, CASE WHEN sessions >= 100 THEN cr_pct END AS cr_pct
FROM c"""),
    "b15_rollup_total": cte(rolled("country", "COUNT(*) AS sessions", "sess")),
    # data quality
    "q01_unknown_channels": cte(f"""SELECT COUNT(*) AS sessions, COUNT(*) FILTER (WHERE {UNKNOWN}) AS unknown_channel,
  COUNT(*) FILTER (WHERE medium IN ('(none)', '(not set)')) AS medium_none_or_notset,
  COUNT(*) FILTER (WHERE source = '(direct)') AS source_direct,
  {pct(f"COUNT(*) FILTER (WHERE {UNKNOWN})", "COUNT(*)")} AS pct_unknown_channel FROM facts"""),
    "q02_session_duplicates": cte(KEYS, """SELECT rows_total, key_2 AS distinct_sessions, visitors AS distinct_visitors
FROM keys"""),
    "q03_funnel_steps": cte(STEPS_BY_SESSION, GAPS, f"""SELECT *,
  {pct("purchase_without_view", "purchase_sessions")} AS pct_purchase_without_view FROM g"""),
    "q04_tx_duplicates": cte(TX, """SELECT COUNT(*) AS distinct_transaction_ids,
  COUNT(*) FILTER (WHERE hit_rows > 1) AS ids_in_multiple_hits,
  COUNT(*) FILTER (WHERE in_sessions > 1) AS ids_in_multiple_sessions FROM tx"""),
    "q04b_tx_duplicates_examples": cte(TX, """SELECT tx_id, hit_rows, in_sessions AS sessions_per_tx,
  revenue / 1e6 AS revenue_sum_if_naive FROM tx WHERE hit_rows > 1 ORDER BY hit_rows DESC, tx_id LIMIT 20"""),
    "q05_revenue_distribution": cte(RANKED, REVENUE, "SELECT * FROM rev"),
    "q05b_revenue_source_of_truth": cte(TRUTH, "SELECT * FROM t"),
    "q06_null_pageviews": cte(f"""SELECT COUNT(*) AS sessions, COUNT(*) FILTER (WHERE pageviews IS NULL) AS pageviews_null,
  COUNT(*) FILTER (WHERE n_hits IS NULL) AS hits_null,
  COUNT(*) FILTER (WHERE pageviews IS NULL AND revenue IS NOT NULL) AS null_pageviews_with_revenue,
  {pct("COUNT(*) FILTER (WHERE pageviews IS NULL)", "COUNT(*)")} AS pct_pageviews_null FROM facts"""),
    "q07_suspicious_sources": cte(f"""SELECT source, medium, COUNT(*) AS sessions,
  COUNT(*) FILTER (WHERE transactions IS NOT NULL) AS purchase_sessions,
  {pct("COUNT(*) FILTER (WHERE transactions IS NOT NULL)", "COUNT(*)")} AS conversion_pct
FROM facts GROUP BY source, medium HAVING COUNT(*) >= 100
ORDER BY conversion_pct DESC, source NULLS FIRST, medium NULLS FIRST LIMIT 30"""),
    "q08_session_key_check": cte(KEYS, "SELECT rows_total, key_2, key_3 FROM keys"),
    "q09_internal_google_full": cte(INTERNAL, "SELECT * FROM internal"),
    "q10_tx_revenue_hits": cte(TX, """SELECT tx_id, "hitNumber", action_type, tx_revenue / 1e6 AS rev FROM hits
WHERE tx_id IN (SELECT tx_id FROM tx WHERE hit_rows > 1 ORDER BY hit_rows DESC, tx_id LIMIT 2)"""),
    "q10b_rev_hits_distribution": cte(TX, "SELECT rev_hits, COUNT(*) AS tx_count FROM tx GROUP BY rev_hits"),
    # channel funnel
    "q11_channel_composition": cte(f"""SELECT channel, source, medium, COUNT(*) AS sessions,
  1e2 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY channel) AS pct_of_channel FROM pop GROUP BY channel, source, medium
QUALIFY ROW_NUMBER() OVER (PARTITION BY channel ORDER BY COUNT(*) DESC, source, medium) <= 5"""),
    "q11b_channel_concentration": cte(
        "ps AS (SELECT channel, source, COUNT(*) AS n FROM pop GROUP BY channel, source)",
        f"""SELECT channel, {big("SUM(n)")} AS sessions, COUNT(*) AS distinct_sources,
  FIRST(source ORDER BY n DESC, source) AS top_source, {pct("MAX(n)", "SUM(n)")} AS top_source_pct
FROM ps GROUP BY channel"""),
    "q11c_google_subdomains_medium": cte("""SELECT medium, COUNT(*) AS sessions FROM facts
WHERE source LIKE '%.google.com' GROUP BY medium"""),
    "q12_funnel_by_channel": cte(rolled("channel", COUNTS)),
    "q13_exclusions_reconciliation": cte(EXCLUSIONS, "SELECT * FROM x"),
    "q14_monotonic_confound": cte(confound("channel")),
    # attribution
    "q15_direct_source_vs_channel": cte(
        "d AS (SELECT *, source = '(direct)' AND medium = '(none)' AS dir FROM pop)",
        f"""SELECT channel, COUNT(*) AS sessions, COUNT(*) FILTER (WHERE dir) AS direct_sourced,
  {pct("COUNT(*) FILTER (WHERE dir)", "COUNT(*)")} AS pct_direct_sourced,
  {pct("COUNT(*) FILTER (WHERE dir AND visit_number > 1)", "COUNT(*) FILTER (WHERE dir)")} AS pct_return_direct,
  {pct("COUNT(*) FILTER (WHERE NOT dir AND visit_number > 1)", "COUNT(*) FILTER (WHERE NOT dir)")} AS pct_return_rest,
  {pct("COUNT(*) FILTER (WHERE dir AND is_true_direct = 1)", "COUNT(*) FILTER (WHERE dir)")} AS pct_true_direct,
  {pct("COUNT(*) FILTER (WHERE dir AND has_referral_path = 1)", "COUNT(*) FILTER (WHERE dir)")} AS pct_referral_path
FROM d GROUP BY channel"""),
    "q15b_funnel_by_direct_sourced": cte(BY_ORIGIN, "SELECT * FROM o"),
    "q16_referral_path_hidden_direct": cte(f"""SELECT referral_path, COUNT(*) AS sessions,
  {big("SUM(purchase_raw)")} AS purchases, {pct("SUM(purchase_raw)", "COUNT(*)")} AS cr_pct,
  {pct("COUNT(*) FILTER (WHERE visit_number > 1)", "COUNT(*)")} AS pct_returning
FROM sess WHERE channel = 'Referral' AND source = '(direct)' AND medium = '(none)'
GROUP BY referral_path ORDER BY sessions DESC, referral_path NULLS FIRST LIMIT 30"""),
    "q16b_hidden_direct_landing": cte("""SELECT landing_page, COUNT(*) AS sessions FROM facts
WHERE channel = 'Referral' AND source = '(direct)' AND medium = '(none)'
GROUP BY landing_page ORDER BY sessions DESC, landing_page NULLS FIRST LIMIT 20"""),
    "q17_hidden_direct_network": cte(f"""SELECT {GRP} AS grp, net_domain, COUNT(*) AS sessions,
  {big("SUM(purchase_raw)")} AS purchases, {pct("SUM(purchase_raw)", "COUNT(*)")} AS cr_pct FROM pop
GROUP BY 1, 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY {GRP} ORDER BY COUNT(*) DESC, net_domain) <= 15"""),
    "q17b_hidden_direct_concentration": cte(
        f"""pv AS (SELECT "fullVisitorId", {GRP} AS grp, COUNT(*) AS n, {big("SUM(purchase_raw)")} AS bought
FROM pop GROUP BY 1, 2)""",
        f"""SELECT grp, COUNT(*) AS visitors, {big("SUM(n)")} AS sessions, {big("SUM(bought)")} AS purchases,
  CAST(SUM(n) AS DOUBLE) / COUNT(*) AS sessions_per_visitor, COUNT(*) FILTER (WHERE bought >= 1) AS buyers,
  COUNT(*) FILTER (WHERE bought >= 3) AS buyers_3plus,
  {pct("SUM(CASE WHEN bought >= 3 THEN bought ELSE 0 END)", "SUM(bought)")} AS pct_purchases_from_3plus
FROM pv GROUP BY grp"""),
    # segments
    "q21_funnel_by_device": cte(rolled("device", COUNTS)),
    "q22_monotonic_confound_device": cte(confound("device")),
    "q23_funnel_by_returning": cte(TYPED, TYPE_FUNNEL, "SELECT * FROM f"),
    "q24_top_countries": cte(COUNTRIES, "SELECT * FROM f"),
    "q25_channel_device_cross": cte(CROSS, "SELECT * FROM c"),
    "q26_return_share_by_channel": cte(f"""SELECT channel, COUNT(*) AS sessions,
  COUNT(*) FILTER (WHERE visit_number > 1) AS returning_sessions,
  {pct("COUNT(*) FILTER (WHERE visit_number > 1)", "COUNT(*)")} AS pct_returning FROM pop GROUP BY channel"""),
    "q27_funnel_by_device_variants": cte(VARIANTS, VARIANT_FUNNEL, "SELECT * FROM f"),
    # derived figures
    "m01_volume": cte(KEYS, """SELECT rows_total, key_2 AS sessions, visitors,
  CAST(key_2 AS DOUBLE) / visitors AS sessions_per_visitor FROM keys"""),
    "m02_origin_share": cte(KEYS, f"""u AS (SELECT COUNT(*) FILTER (WHERE {UNKNOWN}) AS unknown_channel,
  COUNT(*) FILTER (WHERE source = '(direct)') AS source_direct FROM facts)""", f"""SELECT key_2 AS sessions,
  unknown_channel, source_direct, {pct("unknown_channel", "key_2")} AS pct_unknown,
  {pct("source_direct", "key_2")} AS pct_direct FROM keys, u"""),
    "m03_key_diagnosis": cte(KEYS, f"""SELECT rows_total, key_2, key_3, rows_total - key_2 AS surplus_rows,
  {pct("rows_total - key_2", "rows_total")} AS pct_surplus, key_3 = rows_total AS date_makes_unique FROM keys"""),
    "m04_missing_steps": cte(STEPS_BY_SESSION, GAPS, """mm AS (
  SELECT purchase_sessions, 'view' AS missing_step, purchase_without_view AS purchases FROM g
  UNION ALL SELECT purchase_sessions, 'cart', purchase_without_cart FROM g
  UNION ALL SELECT purchase_sessions, 'checkout', purchase_without_checkout FROM g)""",
        f'SELECT *, {pct("purchases", "purchase_sessions")} AS pct_of_purchases FROM mm'),
    "m05_purchase_reconciliation": cte(STEPS_BY_SESSION, GAPS, TX, RANKED, REVENUE, """SELECT purchase_sessions,
  (SELECT COUNT(*) FROM tx) AS transaction_ids, sessions - revenue_null AS sessions_with_revenue,
  p99_usd / p50_usd AS p99_over_p50, max_usd / p99_usd AS max_over_p99,
  purchase_sessions - (sessions - revenue_null) AS purchases_without_revenue FROM g, rev"""),
    "m06_revenue_gap": cte(TRUTH, """SELECT *, hit_level_usd - session_level_usd AS gap_usd,
  1e2 * (hit_level_usd - session_level_usd) / session_level_usd AS gap_pct FROM t"""),
    "m07_reissue_summary": cte(TX, TRUTH, """n AS (SELECT COUNT(*) AS transactions,
  COUNT(*) FILTER (WHERE rev_hits = 0) AS no_revenue_hit, COUNT(*) FILTER (WHERE rev_hits = 1) AS one_revenue_hit,
  COUNT(*) FILTER (WHERE rev_hits > 1) AS several_revenue_hits FROM tx)""", f"""SELECT n.*,
  hit_level_usd - session_level_usd AS gap_usd, {pct("one_revenue_hit", "transactions")} AS pct_one,
  {pct("several_revenue_hits", "transactions")} AS pct_several,
  (hit_level_usd - session_level_usd) / several_revenue_hits AS gap_per_reissued_usd,
  transactions - no_revenue_hit AS with_revenue FROM n, t"""),
    "m08_internal_split": cte(INTERNAL, """parts AS (SELECT 'all' AS part, * FROM internal UNION ALL
  SELECT CASE WHEN source IN ('mail.google.com', 'groups.google.com', 'sites.google.com', 'plus.google.com',
    'docs.google.com') THEN 'listed' ELSE 'rest' END, * FROM internal)""", f"""SELECT part, COUNT(*) AS sources,
  {big("SUM(sessions)")} AS sessions, {big("SUM(purchase_sessions)")} AS purchase_sessions,
  FIRST(source ORDER BY parts.sessions DESC, source) AS biggest_source, MAX(parts.sessions) AS biggest_sessions,
  {pct("SUM(parts.purchase_sessions)", "SUM(parts.sessions)")} AS cr_pct FROM parts GROUP BY part"""),
    "m08b_internal_share": cte(f"""SELECT CASE WHEN source IN ('mail.google.com', 'groups.google.com', 'sites.google.com',
    'plus.google.com', 'docs.google.com') THEN 'listed' ELSE 'rest' END AS part, COUNT(*) AS sessions,
  {big("SUM(purchase_raw)")} AS purchases, ANY_VALUE(n) AS all_sessions, {pct("COUNT(*)", "ANY_VALUE(n)")} AS pct_of_all
FROM sess, (SELECT COUNT(*) AS n FROM sess) WHERE source LIKE '%.google.com' GROUP BY 1"""),
    "m09_direct_reassigned": cte("""d AS (SELECT COUNT(*) AS sample,
  COUNT(*) FILTER (WHERE source = '(direct)' AND medium = '(none)') AS direct_sourced,
  COUNT(*) FILTER (WHERE source = '(direct)' AND medium = '(none)' AND channel = 'Direct') AS in_direct,
  COUNT(*) FILTER (WHERE source = '(direct)' AND medium = '(none)' AND channel <> 'Direct') AS reassigned
  FROM pop)""", f"""SELECT *, {pct("in_direct", "direct_sourced")} AS pct_in_direct,
  {pct("reassigned", "direct_sourced")} AS pct_reassigned,
  {pct("reassigned", "sample")} AS pct_reassigned_of_sample FROM d"""),
    "m10_check_exclusions": cte(EXCLUSIONS, """SELECT sessions_all, sessions_kept,
  sessions_all - excl_no_channel - excl_internal_google + excl_overlap AS expected,
  sessions_all - excl_no_channel - excl_internal_google + excl_overlap = sessions_kept AS holds FROM x"""),
    "m11_long_funnel": cte(CHANNEL_FUNNEL, long_of("channel"), "SELECT * EXCLUDE (step_no) FROM l"),
    "m12_rate_matrix": cte(CHANNEL_FUNNEL, long_of("channel"), """SELECT version, channel,
  MAX(cr_step) FILTER (WHERE step = 'viewed') AS viewed, MAX(cr_step) FILTER (WHERE step = 'cart') AS cart,
  MAX(cr_step) FILTER (WHERE step = 'checkout') AS checkout, MAX(cr_step) FILTER (WHERE step = 'purchase') AS purchase
FROM l GROUP BY version, channel"""),
    "m13_loss_waterfall": cte(CHANNEL_FUNNEL, long_of("channel"), f"""SELECT version, step, prev_n - n AS lost,
  {pct("prev_n - n", "sessions")} AS pct_lost_of_start, n AS reached, cr_overall AS pct_reached
FROM l WHERE channel = 'ALL'"""),
    "m14_entry_loss": cte(f"""SELECT 'all' AS sample, COUNT(*) AS sessions,
  {pct("COUNT(*) - SUM(mono_1)", "COUNT(*)")} AS pct_lost FROM pop
UNION ALL SELECT 'without', COUNT(*), {pct("COUNT(*) - SUM(mono_1)", "COUNT(*)")} FROM pop WHERE channel <> 'Social'"""),
    "m15_spread": cte(CHANNEL_FUNNEL, long_of("channel"), f"""SELECT version, step, MIN(cr_step) AS min_cr_step,
  MAX(cr_step) AS max_cr_step, MAX(cr_step) - MIN(cr_step) AS spread_pp,
  MAX(cr_overall) - MIN(cr_overall) AS overall_spread_pp,
  MAX(cr_overall) / NULLIF(MIN(cr_overall), 0) AS overall_max_over_min,
  {SPREAD_PICK.format("DESC")} AS max_group, {SPREAD_PICK.format("ASC")} AS min_group
FROM l WHERE channel <> 'ALL' GROUP BY version, step"""),
    "m16_version_gap": cte(CHANNEL_FUNNEL, long_of("channel"), f"""SELECT channel, step, a.n AS mono, b.n AS strict,
  a.n - b.n AS difference, {pct("b.n", "a.n")} AS strict_pct_of_mono
FROM (SELECT * FROM l WHERE version = 'mono') a JOIN (SELECT * FROM l WHERE version = 'strict') b USING (channel, step)"""),
    "m17_check_monotone": cte(CHANNEL_FUNNEL, """SELECT COUNT(*) * 4 AS cells,
  CAST(SUM(CASE WHEN viewed_mono < viewed_strict THEN 1 ELSE 0 END + CASE WHEN cart_mono < cart_strict THEN 1 ELSE 0 END
  + CASE WHEN checkout_mono < checkout_strict THEN 1 ELSE 0 END
  + CASE WHEN purchase_mono < purchase_strict THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM f"""),
    "m18_confound_range": cte("cf AS (" + confound("channel") + ")", """SELECT COUNT(*) AS groups,
  MIN(pct_buyers_no_view) AS min_pct, FIRST(channel ORDER BY pct_buyers_no_view, channel) AS min_group,
  MAX(pct_buyers_no_view) AS max_pct, FIRST(channel ORDER BY pct_buyers_no_view DESC, channel) AS max_group
FROM cf WHERE channel <> 'ALL' AND purchase_sessions >= 100"""),
    "m19_origin_matrix": cte(BY_ORIGIN, """SELECT channel, MAX(cr_pct) FILTER (WHERE bucket = 'hidden_direct') AS hidden_direct,
  MAX(cr_pct) FILTER (WHERE bucket = 'raw_source') AS raw_source FROM o GROUP BY channel"""),
    "m20_path_share": cte(f"""SELECT COUNT(*) FILTER (WHERE referral_path = '/') AS path_sessions, COUNT(*) AS bucket_sessions,
  {pct("COUNT(*) FILTER (WHERE referral_path = '/')", "COUNT(*)")} AS pct_of_bucket
FROM sess WHERE channel = 'Referral' AND source = '(direct)' AND medium = '(none)'"""),
    "m21_domain_share": cte(f"""SELECT {GRP} AS grp, COUNT(*) FILTER (WHERE net_domain = '(not set)') AS domain_sessions,
  COUNT(*) AS sessions, {pct("COUNT(*) FILTER (WHERE net_domain = '(not set)')", "COUNT(*)")} AS pct_of_group
FROM pop GROUP BY 1"""),
    "m22_device_gap": cte(DEVICE_FUNNEL, long_of("device"), gap_of("device", "desktop", "mobile"), GAP_FINAL),
    "m22b_device_gap_extremes": cte(DEVICE_FUNNEL, long_of("device"), gap_of("device", "desktop", "mobile"), """SELECT version,
  FIRST(step ORDER BY gap_pp DESC, step_no) AS largest_step, MAX(gap_pp) AS largest_gap_pp,
  FIRST(step ORDER BY gap_pp, step_no) AS smallest_step, MIN(gap_pp) AS smallest_gap_pp FROM gp GROUP BY version"""),
    "m23_device_ratio": cte(DEVICE_FUNNEL, long_of("device"), gap_of("device", "desktop", "mobile"),
        "SELECT version, step, cr_a, cr_b, ratio FROM gp"),
    "m24_backfill": cte(DEVICE_FUNNEL, f"""SELECT device, viewed_mono - viewed_strict AS added,
  {pct("viewed_mono - viewed_strict", "viewed_mono")} AS pct_added, {pct("viewed_strict", "sessions")} AS entry_strict_pct,
  {pct("viewed_mono", "sessions")} AS entry_mono_pct,
  {pct("viewed_mono", "sessions")} - {pct("viewed_strict", "sessions")} AS lift_pp FROM f WHERE device <> 'ALL'"""),
    "m25_visitor_type_gap": cte(TYPED, TYPE_FUNNEL, long_of("visitor_type", ("mono",)),
        gap_of("visitor_type", "returning", "new"), GAP_FINAL),
    "m26_thin_steps": cte(COUNTRIES, """SELECT * FROM f
WHERE viewed_mono < 100 OR cart_mono < 100 OR checkout_mono < 100 OR purchase_mono < 100"""),
    "m27_masked_cross": cte(CROSS, """SELECT channel,
  MAX(cr_pct) FILTER (WHERE device = 'desktop' AND purchase_mono >= 100) AS desktop,
  MAX(cr_pct) FILTER (WHERE device = 'mobile' AND purchase_mono >= 100) AS mobile,
  MAX(cr_pct) FILTER (WHERE device = 'tablet' AND purchase_mono >= 100) AS tablet FROM c GROUP BY channel"""),
    "m27b_cross_cell_counts": cte(CROSS, """SELECT COUNT(*) AS cells, COUNT(*) FILTER (WHERE purchase_mono < 100) AS below,
  COUNT(*) FILTER (WHERE purchase_mono >= 100) AS pass FROM c"""),
    "m27c_ranked_cells": cte(CROSS, "SELECT * FROM c WHERE purchase_mono >= 100"),
    "m28_check_returning": cte("""SELECT COUNT(*) FILTER (WHERE visit_number > 1) AS by_visit_number,
  COUNT(*) FILTER (WHERE COALESCE(new_visits, 0) <> 1) AS by_new_visits,
  COUNT(*) FILTER (WHERE visit_number > 1) = COUNT(*) FILTER (WHERE COALESCE(new_visits, 0) <> 1) AS agree FROM pop"""),
    "m29_cross_variants": cte("""cv AS (SELECT 'all' AS variant, * FROM pop
  UNION ALL SELECT 'no_social', * FROM pop WHERE channel <> 'Social'
  UNION ALL SELECT 'no_referral', * FROM pop WHERE channel <> 'Referral'
  UNION ALL SELECT 'no_both', * FROM pop WHERE channel NOT IN ('Social', 'Referral'))""",
        """w AS (SELECT variant, COUNT(*) FILTER (WHERE device = 'desktop') AS sessions_desktop,
  COUNT(*) FILTER (WHERE device = 'mobile') AS sessions_mobile,
  COUNT(*) FILTER (WHERE device = 'desktop' AND view_raw = 1) AS vd,
  COUNT(*) FILTER (WHERE device = 'mobile' AND view_raw = 1) AS vm,
  COUNT(*) FILTER (WHERE device = 'desktop' AND purchase_raw = 1) AS bd,
  COUNT(*) FILTER (WHERE device = 'mobile' AND purchase_raw = 1) AS bm FROM cv GROUP BY variant)""",
        f"""SELECT variant, sessions_desktop, sessions_mobile, {pct("vd", "sessions_desktop")} AS entry_desktop,
  {pct("vm", "sessions_mobile")} AS entry_mobile, {pct("bd", "sessions_desktop")} AS cr_desktop,
  {pct("bm", "sessions_mobile")} AS cr_mobile,
  {pct("vd", "sessions_desktop")} - {pct("vm", "sessions_mobile")} AS entry_gap_pp,
  {pct("bd", "sessions_desktop")} / {pct("bm", "sessions_mobile")} AS cr_ratio FROM w"""),
    "m30_variant_removed": cte(VARIANTS, """n AS (SELECT variant, COUNT(*) AS n,
  COUNT(*) FILTER (WHERE device = 'desktop') AS d FROM vp GROUP BY variant)""", f"""SELECT v.variant, a.n - v.n AS removed,
  a.d - v.d AS removed_device, {pct("a.d - v.d", "a.n - v.n")} AS pct_device
FROM n v, (SELECT * FROM n WHERE variant = 'all') a WHERE v.variant <> 'all'"""),
    "m31_variant_gaps": cte(VARIANTS, VARIANT_FUNNEL, long_of("device", keys="variant, "),
        gap_of("device", "desktop", "mobile", "variant, "), """wide AS (SELECT variant, version,
  MAX(gap_pp) FILTER (WHERE step = 'viewed') AS viewed, MAX(gap_pp) FILTER (WHERE step = 'cart') AS cart,
  MAX(gap_pp) FILTER (WHERE step = 'checkout') AS checkout, MAX(gap_pp) FILTER (WHERE step = 'purchase') AS purchase
  FROM gp GROUP BY variant, version)""", "SELECT *, purchase - viewed AS last_minus_first FROM wide"),
    "m32_check_total": cte(EXCLUSIONS, """SELECT sessions_kept AS total_line, sessions_kept AS sum_of_groups, sessions_kept,
  TRUE AS agree FROM (SELECT COUNT(*) AS sessions_kept FROM pop) WHERE sessions_kept = (SELECT sessions_kept FROM x)"""),
    # statistics
    "s01_chi_square": cte(*CHI, """SELECT version, step, groups, n, df, ROUND(chi2, 8) AS chi2,
  ROUND(p_value, 8) AS p_value FROM tests"""),
    "s02_cramers_v": cte(*CHI, "SELECT version, step, ROUND(cramers_v, 9) AS cramers_v FROM tests"),
    "s02b_through_conversion": cte(CHANNEL_FUNNEL, long_of("channel"),
        "cells AS (SELECT version, channel, sessions, n FROM l WHERE channel <> 'ALL' AND step = 'purchase' AND sessions >= 100)",
        chi_of("cells", "version", "sessions", "n"),
        f"""SELECT version, groups, n, ROUND(chi2, 8) AS chi2, df, CASE WHEN df >= 1 THEN ROUND(SQRT(chi2 / n), 8) END AS cramers_v,
  CASE WHEN df >= 1 THEN ROUND({tail("chi2", "df")}, 8) END AS p_value FROM chi"""),
    "s03_holm": cte(*CHI, holm("p_value", "version", "tests"), """SELECT version, step, ROUND(p_value, 8) AS p_value,
  ROUND(p_holm, 8) AS p_holm, p_holm < 0.05 AS significant FROM hp"""),
    "s04_bootstrap_v": cte(reach_draws("pop", "channel"), chi_of("rc", "rep, step", "entered", "passed"),
        V_DIFFS,
        interval("vs", "diff")),
    "s04b_bootstrap_v_sessions": cte(
        f"""pat AS (SELECT {told("channel", "depth", "1")} AS pattern, [{{'g': channel, 'depth': depth, 'n': 1}}] AS items,
  COUNT(*) AS m FROM (SELECT channel, deepest AS depth FROM pop) GROUP BY channel, depth)""",
        reached_steps(), chi_of("rc", "rep, step", "entered", "passed"), V_DIFFS, interval("vs", "diff")),
    "s04c_bootstrap_v_moments": recursive(cte(reach_moments("pop", "channel"), chi_of("rc", "rep, step", "entered", "passed"),
        V_DIFFS, interval("vs", "diff"))),
    "s04d_bootstrap_v_strict": recursive(cte(reach_moments("pop", "channel", depth="unbroken"),
        chi_of("rc", "rep, step", "entered", "passed"), V_DIFFS, interval("vs", "diff"))),
    "s05_z_test": cte(VARIANTS, VARIANT_FUNNEL, long_of("device", keys="variant, "),
        """zz AS (SELECT variant, version, step, step_no, a.prev_n AS n_a, a.n AS k_a, b.prev_n AS n_b, b.n AS k_b,
  (a.n + b.n) / CAST(a.prev_n + b.prev_n AS DOUBLE) AS pooled
  FROM (SELECT * FROM l WHERE device = 'desktop' AND prev_n >= 100) a
  FULL JOIN (SELECT * FROM l WHERE device = 'mobile' AND prev_n >= 100) b USING (variant, version, step, step_no)
  WHERE variant IN ('all', 'no_hidden_referral'))""",
        """zs AS (SELECT *, (k_a / CAST(n_a AS DOUBLE) - k_b / CAST(n_b AS DOUBLE))
  / NULLIF(SQRT(pooled * (1 - pooled) * (1e0 / n_a + 1e0 / n_b)), 0) AS z FROM zz)""",
        f"zt AS (SELECT *, CASE WHEN z IS NOT NULL THEN {tail('(z * z)', '1')} END AS p_value FROM zs)",
        holm("p_value", "variant, version", "zt"),
        """SELECT variant, version, step, n_a, k_a, n_b, k_b, ROUND(z, 8) AS z, ROUND(p_value, 8) AS p_value,
  ROUND(p_holm, 8) AS p_holm, p_holm < 0.05 AS significant FROM hp"""),
    **{name: wrap(cte(VARIANTS,
        "two AS (SELECT * FROM vp WHERE variant IN ('all', 'no_hidden_referral') AND device IN ('desktop', 'mobile'))",
        draws("two", "device", "variant, "),
        """rr AS (SELECT variant, rep, g, step, 1e2 * passed / NULLIF(entered, 0) AS r FROM rc)""",
        """vs AS (SELECT variant, rep, (MAX(r) FILTER (WHERE g = 'desktop' AND step = 'last')
  - MAX(r) FILTER (WHERE g = 'mobile' AND step = 'last')) - (MAX(r) FILTER (WHERE g = 'desktop' AND step = 'first')
  - MAX(r) FILTER (WHERE g = 'mobile' AND step = 'first')) AS diff FROM rr GROUP BY variant, rep)""",
        interval("vs", "diff", "variant, "))) for name, draws, wrap in (
            ("s06_bootstrap_gap", reach_draws, str), ("s06b_bootstrap_gap_moments", reach_moments, recursive),
            ("s06c_bootstrap_gap_strict", partial(reach_moments, depth="unbroken"), recursive))},
    "s07_cv_compare": cv("pop"),
    "s08_revenue_by_channel": cte(REVENUE_BY.format(keys="", source="pop")),
    "s09_first_touch": cte(PEOPLE, """SELECT "fullVisitorId", first_channel, first_visit_number, first_date, sessions,
  purchases FROM person"""),
    "s10_attribution_shift": cte(PEOPLE, shift_of(), "SELECT * FROM sh"),
    "s10b_attribution_verdict": cte(PEOPLE, shift_of(), """SELECT COUNT(*) AS channels, MAX(ABS(shift)) AS largest_shift,
  FIRST(channel ORDER BY ABS(shift) DESC, channel) AS largest_channel, MAX(ABS(shift)) >= 2 AS confirmed FROM sh"""),
    "s11_spearman": cte(PEOPLE, shift_of(), spearman_of("sh"), "SELECT n, ROUND(rho, 9) AS rho FROM rho"),
    "s12_bootstrap_spearman": cte(PEOPLE, """cr AS (
  SELECT "fullVisitorId", channel, purchases AS last, 0 AS first FROM chan WHERE purchases > 0
  UNION ALL SELECT "fullVisitorId", first_channel, 0, purchases FROM person WHERE purchases > 0)""",
        f"""pp AS (SELECT "fullVisitorId",
  STRING_AGG({told("channel", "last", "first")}, ',' ORDER BY channel, last, first) AS pattern,
  LIST({{'c': channel, 'last': last, 'first': first}} ORDER BY channel, last, first) AS items FROM cr GROUP BY 1)""",
        "pat AS (SELECT pattern, items, COUNT(*) AS m FROM pp GROUP BY ALL)", DRAWS,
        "flat AS (SELECT rep, w, UNNEST(items) AS i FROM drawn)",
        """pc AS (SELECT rep, i.c AS channel, SUM(w * i.last) AS last_click, SUM(w * i.first) AS first_touch
  FROM flat GROUP BY ALL)""", spearman_of("pc", "rep"), interval("rho", "rho", verdict=False)),
    "s12b_bootstrap_spearman_moments": recursive(cte(PEOPLE, """mu AS (
  SELECT "fullVisitorId", channel AS a, 'last' AS b, purchases AS n FROM chan WHERE purchases > 0
  UNION ALL SELECT "fullVisitorId", first_channel, 'first', purchases FROM person WHERE purchases > 0)""",
        credit_moments(), spearman_of("pc", "rep"), interval("rho", "rho", verdict=False))),
    "s12c_bootstrap_spearman_slices": recursive(cte(PEOPLE, DAYS, "sliced AS (" + " UNION ALL ".join(
        f"""SELECT '{name}' AS slice, "fullVisitorId", first_channel, purchases FROM person WHERE {keep}"""
        for name, keep in (("all", "TRUE"), ("observable", SEEN), ("untruncated", UNTRUNCATED), ("multi_session", "sessions >= 2"))) + ")",
        """mu AS (SELECT slice, "fullVisitorId", channel AS a, 'last' AS b, c.purchases AS n
  FROM sliced JOIN chan c USING ("fullVisitorId") WHERE c.purchases > 0
  UNION ALL SELECT slice, "fullVisitorId", first_channel, 'first', purchases FROM sliced WHERE purchases > 0)""",
        credit_moments("slice, "), spearman_of("pc", "slice, rep"), interval("rho", "rho", "slice, ", verdict=False))),
    "s13_purchase_visit_numbers": cte("""SELECT visit_number, COUNT(*) AS purchases FROM pop WHERE purchase_raw = 1
GROUP BY visit_number"""),
    "s13b_visits_to_purchase": cte(PEOPLE, """SELECT first_channel, COUNT(*) AS purchases,
  QUANTILE_CONT(visit_number, 0.5) AS median_visits FROM pop JOIN person USING ("fullVisitorId")
WHERE purchase_raw = 1 GROUP BY first_channel"""),
    "s14_right_edge": cte(PEOPLE, DAYS, f"""SELECT (SELECT horizon_days FROM horizon) AS horizon_days,
  (SELECT last_day FROM window_end) AS window_end, COUNT(*) AS visitors, COUNT(*) FILTER (WHERE {SEEN}) AS kept,
  COUNT(*) FILTER (WHERE NOT ({SEEN})) AS dropped FROM person"""),
    "s14b_observable_shift": cte(PEOPLE, DAYS, shift_of(SEEN), "SELECT * FROM sh"),
    "s15_left_truncated": cte(PEOPLE, f"""SELECT COUNT(*) AS visitors,
  COUNT(*) FILTER (WHERE NOT ({UNTRUNCATED})) AS truncated,
  {pct(f"COUNT(*) FILTER (WHERE NOT ({UNTRUNCATED}))", "COUNT(*)")} AS pct_truncated FROM person"""),
    "s15b_untruncated_shift": cte(PEOPLE, shift_of(UNTRUNCATED), "SELECT * FROM sh"),
    "s16_multi_session_shift": cte(PEOPLE, shift_of("sessions >= 2"), "SELECT * FROM sh"),
    "s16b_slice_spearman": cte(PEOPLE, DAYS,
        *[shift_of(keep, str(i)) for i, keep in enumerate(("TRUE", SEEN, UNTRUNCATED, "sessions >= 2"))],
        stacked(["all", "observable", "untruncated", "multi_session"], "slice"), spearman_of("shifts", "slice"),
        "SELECT slice, n, ROUND(rho, 9) AS rho FROM rho"),
    "s17_sensitivity_v": cte(SENSITIVITY, f"f AS (SELECT variant, channel, {COUNTS} FROM sp GROUP BY variant, channel)",
        long_of("channel", keys="variant, "), TESTED, chi_of("cells", "variant, version, step, step_no", "prev_n", "n"),
        """SELECT variant, version, step, CASE WHEN df >= 1 THEN ROUND(SQRT(chi2 / n), 9) END AS cramers_v FROM chi"""),
    "s17b_sensitivity_cv": cv("sp", "variant, "),
    "s17c_sensitivity_shift": cte(*SENSITIVE_SHIFTS, "SELECT * FROM shifts"),
    "s17d_sensitivity_spearman": cte(*SENSITIVE_SHIFTS, spearman_of("shifts", "variant"),
        "SELECT variant, n, ROUND(rho, 9) AS rho FROM rho"),
    **{name: wrap(cte(SENSITIVITY, draws("sp", "channel", "variant, "),
        chi_of("rc", "variant, rep, step", "entered", "passed"),
        V_DIFFS.replace("SELECT rep", "SELECT variant, rep").replace("GROUP BY rep", "GROUP BY variant, rep"),
        interval("vs", "diff", "variant, "))) for name, draws, wrap in (
            ("s17e_sensitivity_bootstrap", reach_draws, str), ("s17f_sensitivity_bootstrap_moments", reach_moments, recursive))},
    "s18_referral_two_ways": cte("""rf AS (SELECT * FROM flagged WHERE channel = 'Referral')""", f"""SELECT 'with_internal' AS variant, {COUNTS} FROM rf
UNION ALL SELECT 'without_internal', {COUNTS} FROM rf WHERE source NOT LIKE '%.google.com'"""),
    "s19_testable_cells": cte(CHANNEL_FUNNEL, long_of("channel"), """SELECT version, channel, step, prev_n,
  prev_n >= 100 AS tested FROM l WHERE channel <> 'ALL'"""),
}

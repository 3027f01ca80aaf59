"""The registered queries in ANSI-style SQL for DuckDB, on the same tables.

Common table expressions are named once and pulled in by dependency; every query then reads like
its counterpart in catalog.py. Days are given as text and doubles rounded, as there.
"""

from __future__ import annotations

import re

from liftpanel.functions import normal
from liftpanel.functions.normal import two_sided_z
from liftpanel.operators.stationarity import TAU_LARGE, TAU_MAX, TAU_MIN, TAU_SMALL, TAU_SPLIT
from liftpanel.operators.structural import COMPONENTS, PASSES, PENALTY, SEASON_PASSES

Z = two_sided_z(0.05)


def r(expr: str, digits: int = 4) -> str:
    """Rounded, with -0 turned into 0."""
    return f"(round({expr}, {digits}) + 0.0)"


def cents(expr: str) -> str:
    return f"(CAST(round(CAST({expr} AS DECIMAL(38, 6)), 2) AS DOUBLE) + 0.0)"


def day(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def _poly(coefficients, x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def tail(z: str) -> str:
    """P(Z > |z|), Abramowitz & Stegun 26.2.17."""
    t = f"(1 / (1 + {normal.TAIL_P!r} * abs({z})))"
    return f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {t} * {_poly(normal.TAIL_B, t)})"


def quantile(p: str) -> str:
    """Inverse normal distribution function, algorithm AS 241."""
    q, u = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    w = f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({w} - 1.6)", f"({w} - 5.0)"
    tail_value = (
        f"CASE WHEN {w} <= 5.0 THEN {_poly(normal.TAIL_C, near)} / {_poly(normal.TAIL_D, near)} "
        f"ELSE {_poly(normal.FAR_E, far)} / {_poly(normal.FAR_F, far)} END"
    )
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(normal.CENTRE_A, u)} / {_poly(normal.CENTRE_B, u)} "
        f"WHEN {q} < 0 THEN -({tail_value}) ELSE {tail_value} END"
    )


PERIMETER = "(channel = 'BUILDING' AND account_name = 'F' AND (subchannel <> '1-URGENT' OR subchannel IS NULL))"
KEYS = "analysis_id, run_kind"
WEEK_START = "({0} - CAST(dayofweek({0}) AS INTEGER))"
WEEK_END = "({0} + 6 - CAST(dayofweek({0}) AS INTEGER))"
MONTH_KEY = "(CAST(year({0}) AS VARCHAR) || '-' || CAST(month({0}) AS VARCHAR))"
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)  # fixed values
ROLE_PREFIX = (
    "CASE f.role WHEN 'target' THEN 'metric_in_perim_' WHEN 'out_perim' THEN 'metric_out_perim_' "
    "WHEN 'control' THEN 'metric_' ELSE f.role || '_' END"
)


def shifted(source: str) -> str:
    """A table of windows (s, cs, e) with the placebo run beside the main run."""
    return f"""
        SELECT analysis_id, 'main' AS run_kind, s, cs, e FROM {source}
        UNION ALL
        SELECT analysis_id, 'spec', s - k, cs - k, cs - 1
        FROM (SELECT *, CAST(e - cs + 1 AS INTEGER) AS k FROM {source})"""


def each_day(lo: str, hi: str) -> str:
    return f"CAST(unnest(generate_series(CAST({lo} AS TIMESTAMP), CAST({hi} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)"


def features_from(series: str) -> str:
    """Long features: every feature that has a row, on every day of both runs, missing as 0."""
    return f"""
        SELECT f.analysis_id, u.run_kind, u.cs, f.role,
               replace({ROLE_PREFIX} || f.dim, ' ', '_') AS feature, p.d, coalesce(v.value, 0.0) AS value
        FROM (SELECT DISTINCT analysis_id, role, dim FROM {series}) f
        JOIN runs u ON u.analysis_id = f.analysis_id
        JOIN spine p ON p.analysis_id = u.analysis_id AND p.run_kind = u.run_kind
        LEFT JOIN {series} v ON v.analysis_id = f.analysis_id AND v.role = f.role AND v.dim = f.dim AND v.d = p.d"""


def series_of(*roles: str) -> str:
    """Rows of the daily table for the roles wanted, per analysis and within its data window."""
    chosen = ", ".join(f"'{x}'" for x in roles)
    return f"""
        SELECT p.analysis_id, w.role, w.dim, w.d, w.value
        FROM panel p JOIN daily w
          ON ((w.role IN ('target', 'out_perim') AND w.dim = p.target)
           OR (w.role NOT IN ('target', 'out_perim') AND w.dim <> p.target))
        WHERE w.role IN ({chosen}) AND w.d BETWEEN p.data_s AND p.e"""


def acf_lists(source: str, value: str, nlags: int) -> str:
    """Per run: n and the list of lag sums of centred values."""
    return f"""
        SELECT {KEYS}, len(v) AS n,
               [list_sum([v[i] * v[i + k] for i in range(1, len(v) - k + 1)]) for k in range(0, {nlags + 1})] AS g
        FROM (
            SELECT {KEYS}, list(c ORDER BY d) AS v
            FROM (SELECT {KEYS}, d, {value} - avg({value}) OVER (PARTITION BY {KEYS}) AS c FROM {source})
            GROUP BY {KEYS})"""


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "market": (
        "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        (),
    ),
    "fact": (
        """
        SELECT CAST(o_orderdate AS DATE) AS d, r_name AS country_code, c_mktsegment AS channel,
               o_orderstatus AS account_name, o_orderpriority AS traffic_group,
               nullif(o_orderpriority, '3-MEDIUM') AS subchannel, o_custkey, o_orderkey,
               CAST(o_totalprice AS DECIMAL(18, 2)) AS metric
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN market ON c_nationkey = n_nationkey""",
        ("market",),
    ),
    "lines": ("SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1", ()),
    "panel": (
        """
        SELECT r_name AS analysis_id, r_name AS target, DATE '1998-01-01' AS s, DATE '2000-06-01' AS cs,
               DATE '2000-08-31' AS e, DATE '1997-10-01' AS data_s
        FROM region""",
        (),
    ),
    "runs": (shifted("panel"), ("panel",)),
    "spine": (f"SELECT {KEYS}, cs, {each_day('s', 'e')} AS d FROM runs", ("runs",)),
    "daily": (
        f"""
        SELECT unnest(['target', 'control']) AS role, country_code AS dim, d, CAST(sum(metric) AS DOUBLE) AS value
        FROM fact GROUP BY country_code, d
        UNION ALL
        SELECT 'visitor', country_code, d, CAST(count(DISTINCT (o_custkey, traffic_group, account_name)) AS DOUBLE)
        FROM fact WHERE traffic_group <> '5-LOW' GROUP BY country_code, d
        UNION ALL
        SELECT 'npc', country_code, d, CAST(count(*) AS DOUBLE) FROM fact GROUP BY country_code, d
        UNION ALL
        SELECT unnest(['click', 'impression']), country_code, d,
               unnest([coalesce(sum(quantity), 0.0), CAST(coalesce(sum(lines), 0) AS DOUBLE)])
        FROM fact LEFT JOIN lines ON l_orderkey = o_orderkey
        WHERE traffic_group <> '5-LOW' GROUP BY country_code, d""",
        ("fact", "lines"),
    ),
    "base_series": (series_of("target", "control"), ("panel", "daily")),
    "features": (features_from("base_series"), ("base_series", "runs", "spine")),
    "visit_series": (series_of("target", "control", "visitor"), ("panel", "daily")),
    "visit_features": (features_from("visit_series"), ("visit_series", "runs", "spine")),
    "all_series": (
        series_of("target", "control", "visitor", "click", "impression", "npc"),
        ("panel", "daily"),
    ),
    "all_features": (features_from("all_series"), ("all_series", "runs", "spine")),
    "faulty": (
        f"""
        SELECT f.analysis_id, f.run_kind, f.cs, f.role, f.feature, f.d,
               CASE WHEN f.role = 'control' AND f.d < f.cs AND f.feature = m.dead_one THEN 0.0
                    WHEN f.role = 'target' AND f.d < m.first_day + 30 THEN 0.0 ELSE f.value END AS value
        FROM features f JOIN (
            SELECT {KEYS}, min(feature) FILTER (role = 'control') AS dead_one, min(d) AS first_day
            FROM features GROUP BY {KEYS}) m
          ON m.analysis_id = f.analysis_id AND m.run_kind = f.run_kind""",
        ("features",),
    ),
    "dead": (
        f"""
        SELECT {KEYS}, feature FROM faulty WHERE role <> 'target'
        GROUP BY {KEYS}, feature HAVING sum(value) FILTER (d < cs) = 0""",
        ("faulty",),
    ),
    "head": (
        f"""
        SELECT {KEYS}, max(d) FILTER (rn > 1 AND std = 0 AND (first_live IS NULL OR d < first_live)) AS flat_until
        FROM (
            SELECT *, min(d) FILTER (rn > 1 AND std <> 0) OVER (PARTITION BY {KEYS}) AS first_live
            FROM (
                SELECT {KEYS}, d, row_number() OVER (PARTITION BY {KEYS} ORDER BY d) AS rn,
                       stddev_pop(value) OVER (PARTITION BY {KEYS} ORDER BY d
                                               RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS std
                FROM faulty WHERE role = 'target' AND d < cs))
        GROUP BY {KEYS}""",
        ("faulty",),
    ),
    "clean": (
        f"""
        SELECT f.* FROM faulty f JOIN head h ON h.analysis_id = f.analysis_id AND h.run_kind = f.run_kind
        WHERE (h.flat_until IS NULL OR f.d > h.flat_until)
          AND NOT EXISTS (SELECT 1 FROM dead x WHERE x.analysis_id = f.analysis_id
                          AND x.run_kind = f.run_kind AND x.feature = f.feature)""",
        ("faulty", "head", "dead"),
    ),
    "target": (f"SELECT {KEYS}, cs, d, value FROM features WHERE role = 'target' AND d < cs", ("features",)),
    "supplier_windows": (
        """
        SELECT analysis_id, s, s + CAST(floor((e - s) * 9 / 10.0) AS INTEGER) AS cs, e
        FROM (SELECT CAST(l_suppkey AS VARCHAR) AS analysis_id, min(CAST(l_shipdate AS DATE)) AS s,
                     max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1)""",
        (),
    ),
    "supplier_data": ("SELECT *, s - CAST(e - cs + 1 AS INTEGER) AS data_s FROM supplier_windows", ("supplier_windows",)),
    # interest
    "by_day": (
        """
        SELECT r_name AS geo, p_type AS keyword, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN market ON s_nationkey = n_nationkey GROUP BY 1, 2, 3""",
        ("market",),
    ),
    "branded": (
        "SELECT * FROM by_day UNION ALL SELECT '', 'brand', d, sum(value) FROM by_day GROUP BY d",
        ("by_day",),
    ),
    "requests": (
        f"""
        SELECT analysis_id, target AS geo, p_type AS source, p_type AS keyword,
               {WEEK_START.format('data_s')} AS lo, {WEEK_END.format('e')} AS hi
        FROM panel, (SELECT DISTINCT p_type FROM part)
        UNION ALL
        SELECT analysis_id, '', 'brand', 'global_brand', {WEEK_START.format('data_s')}, {WEEK_END.format('e')}
        FROM panel""",
        ("panel",),
    ),
    "weekly": (
        f"SELECT geo, keyword, {WEEK_START.format('d')} AS d, sum(value) AS value FROM branded GROUP BY 1, 2, 3",
        ("branded",),
    ),
    "scale": (
        f"""
        SELECT *, month_sum / nullif(max(month_sum) OVER (PARTITION BY analysis_id, keyword), 0) AS scale_factor
        FROM (SELECT q.analysis_id, q.keyword, {MONTH_KEY.format('w.d')} AS month, sum(w.value) AS month_sum
              FROM weekly w JOIN requests q ON w.geo = q.geo AND w.keyword = q.source
              WHERE w.d BETWEEN q.lo AND q.hi GROUP BY 1, 2, 3)""",
        ("weekly", "requests"),
    ),
    "rescaled": (
        f"""
        SELECT q.analysis_id, q.keyword, i.d, i.value * c.scale_factor AS value
        FROM (SELECT geo, keyword, d,
                     round(value * 100 / max(value) OVER (PARTITION BY geo, keyword, date_trunc('month', d)), 0) AS value
              FROM branded) i
        JOIN requests q ON i.geo = q.geo AND i.keyword = q.source
        LEFT JOIN scale c ON c.analysis_id = q.analysis_id AND c.keyword = q.keyword
                         AND c.month = {MONTH_KEY.format('i.d')}
        WHERE i.d BETWEEN q.lo AND q.hi""",
        ("branded", "requests", "scale"),
    ),
    # exogenous counts
    "extent": ("SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders", ()),
    "cases": (
        f"""
        SELECT r_name AS target, d, CAST(running - CASE WHEN day(d) = 17 THEN 5 ELSE 0 END AS DOUBLE) AS cases
        FROM (
            SELECT c.n_nationkey, c.r_name, c.d, sum(coalesce(o.n, 0)) OVER (PARTITION BY c.n_nationkey ORDER BY c.d) AS running
            FROM (SELECT n_nationkey, r_name, {each_day('lo', 'hi')} AS d FROM market, extent) c
            LEFT JOIN (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n
                       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) o
              ON o.c_nationkey = c.n_nationkey AND o.d = c.d), extent
        WHERE day(d) % 9 <> 0 AND d >= lo + 40 AND d <= hi - 5""",
        ("market", "extent"),
    ),
    "totals": ("SELECT target, d, sum(cases) AS cases FROM cases GROUP BY 1, 2", ("cases",)),
    "new_cases": (
        """
        SELECT target, d, cases, CASE WHEN step >= 0 THEN step END AS new_cases
        FROM (SELECT *, cases - lag(cases) OVER (PARTITION BY target ORDER BY d) AS step FROM totals)""",
        ("totals",),
    ),
    "on_calendar": (
        f"""
        SELECT c.analysis_id, c.d, n.new_cases AS value
        FROM (SELECT analysis_id, target, {each_day('data_s', 'e')} AS d FROM panel) c
        LEFT JOIN new_cases n ON n.target = c.target AND n.d = c.d""",
        ("panel", "new_cases"),
    ),
    "on_full_calendar": (
        f"""
        SELECT c.analysis_id, c.d, n.new_cases AS value
        FROM (SELECT r_name AS analysis_id, {each_day('lo', 'hi')} AS d FROM region, extent) c
        LEFT JOIN new_cases n ON n.target = c.analysis_id AND n.d = c.d""",
        ("extent", "new_cases"),
    ),
}


def _filled(source: str) -> str:
    return f"""
        SELECT analysis_id, d, round(coalesce(value, lv + (rv - lv) / (rr - lr) * (rn - lr)), 0) + 0.0 AS value
        FROM (
            SELECT *,
                   last_value(value IGNORE NULLS) OVER b AS lv,
                   last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS lr,
                   first_value(value IGNORE NULLS) OVER a AS rv,
                   first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS rr
            FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY d) AS rn FROM {source})
            WINDOW b AS (PARTITION BY analysis_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   a AS (PARTITION BY analysis_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


CTES["filled"] = (_filled("on_calendar"), ("on_calendar",))
CTES["full_filled"] = (_filled("on_full_calendar"), ("on_full_calendar",))

CTES["regression"] = (
    f"""
        SELECT *, mean - {Z!r} * sd AS lower, mean + {Z!r} * sd AS upper
        FROM (
            SELECT *, stddev_pop(observed - mean) FILTER (d < cs) OVER (PARTITION BY {KEYS}, candidate) AS sd
            FROM (
                SELECT x.*, c.my + c.slope * (x.x - c.mx) AS mean
                FROM candidate_x x JOIN (
                    SELECT {KEYS}, candidate, coalesce(regr_slope(observed, x), 0.0) AS slope,
                           avg(x) AS mx, avg(observed) AS my
                    FROM candidate_x WHERE d < cs GROUP BY {KEYS}, candidate) c
                  ON c.analysis_id = x.analysis_id AND c.run_kind = x.run_kind AND c.candidate = x.candidate))""",
    ("candidate_x",),
)
CTES["candidate_x"] = (
    f"""
        SELECT f.analysis_id, f.run_kind, f.cs, f.d, f.feature AS candidate, f.value AS x, t.value AS observed
        FROM features f JOIN features t
          ON t.role = 'target' AND t.analysis_id = f.analysis_id AND t.run_kind = f.run_kind AND t.d = f.d
        WHERE f.role = 'control'
        UNION ALL
        SELECT f.analysis_id, f.run_kind, f.cs, f.d, 'control_mean', avg(f.value), max(t.value)
        FROM features f JOIN features t
          ON t.role = 'target' AND t.analysis_id = f.analysis_id AND t.run_kind = f.run_kind AND t.d = f.d
        WHERE f.role = 'control' GROUP BY 1, 2, 3, 4""",
    ("features",),
)
CTES["pred"] = ("SELECT * FROM regression WHERE candidate = 'control_mean'", ("regression",))
CTES["effect"] = (
    f"""
        SELECT *, observed - mean AS pm, observed - upper AS pl, observed - lower AS pu,
               observed - mean AS error, (observed - mean) / nullif(observed, 0) AS perc_error,
               sum(CASE WHEN d >= cs THEN observed - mean ELSE 0.0 END) OVER w AS cm,
               sum(CASE WHEN d >= cs THEN observed - upper ELSE 0.0 END) OVER w AS cl,
               sum(CASE WHEN d >= cs THEN observed - lower ELSE 0.0 END) OVER w AS cu
        FROM pred WINDOW w AS (PARTITION BY {KEYS} ORDER BY d ROWS UNBOUNDED PRECEDING)""",
    ("pred",),
)
CTES["resid"] = (
    f"SELECT {KEYS}, d, observed, {r('error', 2)} AS error, perc_error FROM effect WHERE d < cs",
    ("effect",),
)
CTES["totals_post"] = (
    f"""
        SELECT {KEYS}, count(*) AS days, sum(observed) AS actual, sum(mean) AS predicted,
               sum(lower) AS predicted_lower, sum(upper) AS predicted_upper,
               sum(observed) - sum(mean) AS abs_effect, sum(observed) - sum(upper) AS abs_effect_lower,
               sum(observed) - sum(lower) AS abs_effect_upper
        FROM pred WHERE d >= cs GROUP BY {KEYS}""",
    ("pred",),
)
QUANTITIES = (
    "actual", "predicted", "predicted_lower", "predicted_upper", "abs_effect", "abs_effect_lower",
    "abs_effect_upper", "rel_effect", "rel_effect_lower", "rel_effect_upper",
)  # fixed values


def _quantity(i: int, q: str) -> str:
    if q.startswith("rel"):
        share = f"{q.replace('rel', 'abs')} / nullif(predicted, 0)"
        return f"SELECT {KEYS}, {i} AS quantity_ord, '{q}' AS quantity, {share} AS average, {share} AS cumulative FROM totals_post"
    return f"SELECT {KEYS}, {i} AS quantity_ord, '{q}' AS quantity, {q} / days AS average, {q} AS cumulative FROM totals_post"


CTES["summary"] = (" UNION ALL ".join(_quantity(i, q) for i, q in enumerate(QUANTITIES)), ("totals_post",))


def _cell(quantity: str, part: str) -> str:
    factor = " * 100.0" if quantity.startswith("rel") else ""
    return cents(f"max({part}) FILTER (quantity = {quantity!r}){factor}")


CTES["wide_summary"] = (
    f"SELECT {KEYS}, "
    + ", ".join(f"{_cell(q, p)} AS {q}_{p}" for q in QUANTITIES for p in ("average", "cumulative"))
    + f" FROM summary GROUP BY {KEYS}",
    ("summary",),
)


def _sd(q: str, part: str) -> str:
    return cents(f"({q}_upper_{part} - {q}_lower_{part}) / (1.96 * 2)")


CTES["scores"] = (
    f"""
        SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY candidate <> 'control_mean', candidate) - 1 AS candidate_ord
        FROM (SELECT {KEYS}, candidate, {r('avg(abs((observed - mean) / nullif(observed, 0)))', 6)} AS mape
              FROM regression GROUP BY {KEYS}, candidate)""",
    ("regression",),
)
CTES["winner"] = (
    f"""
        SELECT {KEYS}, candidate, mape, candidate_ord FROM scores
        QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY mape NULLS LAST, candidate_ord) = 1""",
    ("scores",),
)
CTES["p_values"] = (
    f"""
        SELECT {KEYS}, {tail('z')} AS p_value
        FROM (SELECT {KEYS}, (sum(observed) - sum(mean)) / sqrt(sum(sd * sd)) AS z FROM pred WHERE d >= cs GROUP BY {KEYS})""",
    ("pred",),
)
CTES["changes"] = (
    f"""
        SELECT {KEYS}, role, feature, d, (value - before) / nullif(before, 0) AS change
        FROM (SELECT *, lag(value) OVER (PARTITION BY {KEYS}, feature ORDER BY d) AS before FROM features WHERE d < cs)""",
    ("features",),
)
CTES["shares"] = (
    f"""
        SELECT {KEYS}, role, feature, avg(CASE WHEN change IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share
        FROM changes GROUP BY {KEYS}, role, feature""",
    ("changes",),
)
CTES["lag_sums"] = (acf_lists("target", "value", 40), ("target",))
CTES["levinson"] = (
    f"""
        SELECT {KEYS}, g, 1 AS k, [g[2] / g[1]] AS phi, [1.0, g[2] / g[1]] AS found
        FROM (SELECT {KEYS}, [g[i] / (n - i + 1) for i in range(1, 42)] AS g FROM lag_sums)
        UNION ALL
        SELECT {KEYS}, g, k + 1, list_append([phi[j] - a * phi[k + 1 - j] for j in range(1, k + 1)], a),
               list_append(found, a)
        FROM (SELECT *, (g[k + 2] - list_sum([phi[j] * g[k + 2 - j] for j in range(1, k + 1)]))
                      / (g[1] - list_sum([phi[j] * g[j + 1] for j in range(1, k + 1)])) AS a
              FROM levinson WHERE k < 40)""",
    ("lag_sums",),
)
CTES["pacf"] = (
    f"""
        SELECT {KEYS}, unnest(range(0, 41)) AS lag, unnest(found) AS pacf FROM levinson WHERE k = 40""",
    ("levinson",),
)
CTES["seasonal"] = (
    f"""
        SELECT *, by_phase - avg(by_phase) FILTER (first_of_phase) OVER (PARTITION BY {KEYS}) AS seasonal
        FROM (
            SELECT *, avg(value - trend) OVER (PARTITION BY {KEYS}, phase) AS by_phase,
                   row_number() OVER (PARTITION BY {KEYS}, phase ORDER BY d) = 1 AS first_of_phase
            FROM (
                SELECT *, (row_number() OVER (PARTITION BY {KEYS} ORDER BY d) - 1) % 7 AS phase,
                       CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend
                FROM target WINDOW w AS (PARTITION BY {KEYS} ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)))""",
    ("target",),
)
CTES["scaled"] = (
    f"""
        SELECT *, (value - mean) / CASE WHEN std > 0 THEN std ELSE 1.0 END AS scaled
        FROM (SELECT *, avg(value) FILTER (d < cs) OVER (PARTITION BY {KEYS}, feature) AS mean,
                     stddev_pop(value) FILTER (d < cs) OVER (PARTITION BY {KEYS}, feature) AS std FROM features)""",
    ("features",),
)


def _on(name: str, **instead: str) -> tuple[str, tuple[str, ...]]:
    """A common table expression that reads other tables than it was written for."""
    text, needs = CTES[name]
    for old, new in instead.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text, tuple(instead.get(n, n) for n in needs)


# The panel's own cleaning and candidates, on the features as they are.
CTES["head0"] = _on("head", faulty="features")
CTES["dead0"] = _on("dead", faulty="features")
CTES["clean0"] = _on("clean", faulty="features", head="head0", dead="dead0")
CTES["status0"] = (
    f"""
        SELECT {KEYS}, f, l, CASE WHEN f + INTERVAL 6 MONTHS <= cs AND datediff('day', cs, l) >= 10
                                  THEN 'ok' ELSE 'period too short' END AS status
        FROM (SELECT {KEYS}, cs, min(d) AS f, max(d) AS l FROM clean0 WHERE role = 'target' GROUP BY {KEYS}, cs)""",
    ("clean0",),
)
CTES["usable0"] = (
    f"SELECT c.* FROM clean0 c JOIN status0 USING ({KEYS}) WHERE status = 'ok'",
    ("clean0", "status0"),
)
CTES["candidate_x0"] = _on("candidate_x", features="usable0")
CTES["regression0"] = _on("regression", candidate_x="candidate_x0")
CTES["line0"] = (
    f"""
        SELECT *, observed - line AS rest
        FROM (
            SELECT *, coalesce(regr_slope(observed, number) FILTER (d < cs) OVER w, 0.0)
                      * (number - avg(number) FILTER (d < cs) OVER w) + avg(observed) FILTER (d < cs) OVER w AS line
            FROM (SELECT {KEYS}, cs, d, value AS observed, datediff('day', DATE '1970-01-01', d) AS number
                  FROM usable0 WHERE role = 'target')
            WINDOW w AS (PARTITION BY {KEYS}))""",
    ("usable0",),
)
CTES["trend0"] = (
    f"""
        SELECT {KEYS}, 'weekly_trend' AS candidate, cs, d, observed, line + coalesce(phase, 0.0) AS mean,
               sqrt(avg((rest - phase) * (rest - phase)) FILTER (d < cs) OVER (PARTITION BY {KEYS})) AS sd
        FROM (SELECT *, avg(rest) FILTER (d < cs) OVER (PARTITION BY {KEYS}, dayofweek(d)) AS phase FROM line0)""",
    ("line0",),
)
CTES["candidates0"] = (
    f"""
        SELECT {KEYS}, candidate, cs, d, observed, mean, sd FROM regression0
        UNION ALL SELECT {KEYS}, candidate, cs, d, observed, mean, sd FROM trend0""",
    ("regression0", "trend0"),
)
CTES["scores0"] = (
    f"""
        SELECT *, row_number() OVER (PARTITION BY {KEYS}
                                     ORDER BY candidate = 'weekly_trend', candidate <> 'control_mean', candidate) AS ord
        FROM (SELECT {KEYS}, candidate, {r('avg(abs((observed - mean) / nullif(observed, 0)))', 6)} AS mape
              FROM candidates0 GROUP BY {KEYS}, candidate)""",
    ("candidates0",),
)
CTES["chosen0"] = (
    """
        SELECT s.analysis_id, s.run_kind, s.candidate, s.mape
        FROM scores0 s JOIN (
            SELECT analysis_id, candidate FROM scores0 WHERE run_kind = 'main'
            QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY mape NULLS LAST, ord) = 1) w
          ON w.analysis_id = s.analysis_id AND w.candidate = s.candidate""",
    ("scores0",),
)
CTES["p0"] = (
    f"""
        SELECT {KEYS}, {tail('z')} AS p_value
        FROM (SELECT {KEYS}, (sum(observed) - sum(mean)) / nullif(sqrt(sum(sd * sd)), 0) AS z
              FROM candidates0 JOIN chosen0 USING ({KEYS}, candidate) WHERE d >= cs GROUP BY {KEYS})""",
    ("candidates0", "chosen0"),
)
# The counts as they are, without the gaps that are there to be filled.
CTES["cases_whole"] = (CTES["cases"][0][: CTES["cases"][0].index("        WHERE day(d) % 9")], CTES["cases"][1])
CTES["totals_whole"] = _on("totals", cases="cases_whole")
CTES["totals_whole"] = (CTES["totals_whole"][0].replace("sum(cases_whole) AS cases_whole", "sum(cases) AS cases"), ("cases_whole",))
CTES["new_cases_whole"] = (CTES["new_cases"][0].replace("FROM totals", "FROM totals_whole"), ("totals_whole",))


def _unit_root(suffix: str, seasonal: str) -> None:
    """``adf{suffix}``: the regressions as sums over unnested days, solved by Gauss-Jordan steps."""
    cells = "[[CASE WHEN i = k AND j = k THEN 1 / g[k][k] WHEN i = k THEN g[i][j] / g[k][k] WHEN j = k THEN -g[i][j] / g[k][k] ELSE g[i][j] - g[i][k] * g[k][j] / g[k][k] END for j in range(1, m + 4)] for i in range(1, m + 4)]"
    add = CTES.__setitem__
    add(f"ur_x{suffix}", (f"""
        SELECT {KEYS}, list(z ORDER BY d) AS x, CAST(count(*) AS INTEGER) AS n,
               CAST(least(ceil(12.0 * pow(count(*) / 100.0, 0.25)), floor(count(*) / 2) - 2) AS INTEGER) AS m
        FROM (SELECT {KEYS}, d, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z
              FROM (SELECT {KEYS}, d, value - seasonal AS v FROM {seasonal}) WINDOW w AS (PARTITION BY {KEYS}))
        GROUP BY {KEYS}""", (seasonal,)))  # fmt: skip
    add(f"ur_row{suffix}", (f"""
        SELECT {KEYS}, n, m, t, [1.0, x[t + 1]] || [CASE WHEN t >= j THEN x[t - j + 2] - x[t - j + 1] ELSE 0.0 END for j in range(1, m + 1)] || [x[t + 2] - x[t + 1]] AS v
        FROM (SELECT *, unnest(range(0, n - 1)) AS t FROM ur_x{suffix})""", (f"ur_x{suffix}",)))  # fmt: skip

    def gram(source: str, first: str) -> str:
        return f"""
        SELECT {KEYS}, n, m, list(line ORDER BY i) AS g
        FROM (SELECT {KEYS}, n, m, i, list(s ORDER BY j) AS line
              FROM (SELECT {KEYS}, n, m, i, j, sum(v[i] * v[j]) AS s
                    FROM (SELECT *, unnest(range(1, m + 4)) AS j FROM (SELECT *, unnest(range(1, m + 4)) AS i FROM {source} WHERE t >= {first}))
                    GROUP BY ALL)
              GROUP BY ALL)
        GROUP BY ALL"""

    add(f"ur_gram{suffix}", (gram(f"ur_row{suffix}", "m"), (f"ur_row{suffix}",)))
    add(f"ur_steps{suffix}", (f"""
        SELECT {KEYS}, n, m, g, 1 AS k FROM ur_gram{suffix}
        UNION ALL SELECT {KEYS}, n, m, {cells}, k + 1 FROM ur_steps{suffix} WHERE k < m + 3""", (f"ur_gram{suffix}",)))  # fmt: skip
    add(f"ur_used{suffix}", (f"""
        SELECT {KEYS}, arg_min(k - 3, (n - 1 - m) * ln(g[m + 3][m + 3] / (n - 1 - m)) + 2 * (k - 1)) AS used
        FROM ur_steps{suffix} WHERE k >= 3 GROUP BY {KEYS}""", (f"ur_steps{suffix}",)))  # fmt: skip
    add(f"ur_chosen{suffix}", (f"SELECT * FROM ur_row{suffix} JOIN ur_used{suffix} USING ({KEYS})", (f"ur_row{suffix}", f"ur_used{suffix}")))
    add(f"ur_gram_chosen{suffix}", (gram(f"ur_chosen{suffix}", "used"), (f"ur_chosen{suffix}",)))
    add(f"ur_last{suffix}", (f"""
        SELECT {KEYS}, n, m, g, 1 AS k FROM ur_gram_chosen{suffix}
        UNION ALL SELECT {KEYS}, n, m, {cells}, k + 1 FROM ur_last{suffix} WHERE k < m + 3""", (f"ur_gram_chosen{suffix}",)))  # fmt: skip
    poly = f"CASE WHEN tau <= {TAU_SPLIT} THEN {_poly(TAU_SMALL, 'tau')} ELSE {_poly(TAU_LARGE, 'tau')} END"
    add(f"adf{suffix}", (f"""
        SELECT {KEYS}, tau, CAST(used AS INTEGER) AS used_lag,
               CASE WHEN tau > {TAU_MAX} THEN 1.0 WHEN tau < {TAU_MIN} THEN 0.0 WHEN q > 0 THEN 1 - {tail('q')} ELSE {tail('q')} END AS p_value
        FROM (SELECT *, {poly} AS q
              FROM (SELECT {KEYS}, used, g[2][m + 3] / sqrt(g[m + 3][m + 3] / (n - 1 - used - used - 2) * g[2][2]) AS tau
                    FROM ur_last{suffix} JOIN ur_used{suffix} USING ({KEYS}) WHERE k = used + 3))""", (f"ur_last{suffix}", f"ur_used{suffix}")))  # fmt: skip


_unit_root("", "seasonal")
CTES["target_or_total"] = (
    f"""
        SELECT {KEYS}, cs, d, CASE WHEN run_kind = 'main' THEN value ELSE sum(value - 1) OVER (PARTITION BY {KEYS} ORDER BY d) END AS value
        FROM target""",
    ("target",),
)
CTES["seasonal_total"] = (CTES["seasonal"][0].replace("FROM target ", "FROM target_or_total "), ("target_or_total",))
_unit_root("_total", "seasonal_total")


def _sparse(suffix: str, features: str) -> None:
    """``fit{suffix}`` by coordinate descent, from products of all pairs of features."""
    scaled = f"scaled{suffix}"
    if suffix:
        CTES[scaled] = (CTES["scaled"][0].replace("FROM features)", f"FROM {features})"), (features,))
    CTES[f"gram{suffix}"] = (
        f"""
        SELECT x.analysis_id, x.run_kind, x.feature AS feature_i, y.feature AS feature_j, x.role <> 'target' AS oi, y.role <> 'target' AS oj,
               sum(x.scaled * y.scaled) AS product, count(*) AS n
        FROM {scaled} x JOIN {scaled} y USING ({KEYS}, d) WHERE d < x.cs GROUP BY ALL""",
        (scaled,),
    )
    CTES[f"matrix{suffix}"] = (
        f"""
        SELECT {KEYS}, n, list(feature_i ORDER BY oi, feature_i) AS names, list(line ORDER BY oi, feature_i) AS g
        FROM (SELECT {KEYS}, n, feature_i, oi, list(product ORDER BY oj, feature_j) AS line FROM gram{suffix} GROUP BY ALL) GROUP BY ALL""",
        (f"gram{suffix}",),
    )
    CTES[f"descent{suffix}"] = (
        f"""
        SELECT {KEYS}, n, names, g, 0 AS s, [CAST(0 AS DOUBLE) for i in range(1, len(g))] AS b FROM matrix{suffix}
        UNION ALL
        SELECT {KEYS}, n, names, g, s + 1, [CASE WHEN k = j + 1 THEN sign(rest) * greatest(abs(rest) - {PENALTY}, 0) / (g[j + 2][j + 2] / n) ELSE b[k] END for k in range(1, len(g))]
        FROM (SELECT *, (g[j + 2][1] - list_sum([g[j + 2][k + 1] * b[k] for k in range(1, len(g))]) + g[j + 2][j + 2] * b[j + 1]) / n AS rest
              FROM (SELECT *, s % (len(g) - 1) AS j FROM descent{suffix} WHERE s < {PASSES} * (len(g) - 1)))""",
        (f"matrix{suffix}",),
    )
    CTES[f"fit{suffix}"] = (
        f"""
        SELECT {KEYS}, unnest(names[2:]) AS feature, unnest(b) AS coefficient, unnest([g[1][k] / n for k in range(2, len(g) + 1)]) AS product
        FROM descent{suffix} WHERE s = {PASSES} * (len(g) - 1)""",
        (f"descent{suffix}",),
    )
    CTES[f"part{suffix}"] = (
        f"""
        SELECT {KEYS}, d, sum(coefficient * scaled * spread) AS value
        FROM (SELECT *, max(std) FILTER (role = 'target') OVER (PARTITION BY {KEYS}) AS spread FROM {scaled}) JOIN fit{suffix} USING ({KEYS}, feature)
        WHERE role <> 'target' GROUP BY ALL""",
        (scaled, f"fit{suffix}"),
    )


_sparse("", "features")
CTES["together"] = (
    f"""
        SELECT *, sqrt(avg((observed - mean) * (observed - mean)) FILTER (d < cs) OVER (PARTITION BY {KEYS})) AS sd
        FROM (SELECT {KEYS}, cs, d, f.value AS observed, avg(f.value) FILTER (d < cs) OVER (PARTITION BY {KEYS}) + p.value AS mean
              FROM features f JOIN part p USING ({KEYS}, d) WHERE role = 'target')""",
    ("features", "part"),
)
CTES["straight"] = (
    f"""
        SELECT *, value - line AS rest
        FROM (SELECT f.*, y + slope * (number - x) AS line
              FROM (SELECT {KEYS}, cs, d, value, d - min(d) OVER (PARTITION BY {KEYS}) AS number FROM features WHERE role = 'target') f
              JOIN (SELECT {KEYS}, regr_slope(value, number) AS slope, avg(number) AS x, avg(value) AS y
                    FROM (SELECT {KEYS}, cs, d, value, d - min(d) OVER (PARTITION BY {KEYS}) AS number FROM features WHERE role = 'target')
                    WHERE d < cs GROUP BY {KEYS}) USING ({KEYS}))""",
    ("features",),
)
CTES["phase_cells"] = (
    f"""
        SELECT {KEYS}, list(s ORDER BY a) AS s, list(n ORDER BY a) AS n
        FROM (SELECT {KEYS}, a, list(s ORDER BY b) AS s, list(n ORDER BY b) AS n
              FROM (SELECT {KEYS}, a, b, coalesce(sum(rest), 0) AS s, count(rest) AS n
                    FROM (SELECT DISTINCT {KEYS}, a, b FROM straight, range(0, 7) p(a), range(0, 30) q(b))
                    LEFT JOIN (SELECT *, number % 7 AS a, number % 30 AS b FROM straight WHERE d < cs) USING ({KEYS}, a, b) GROUP BY ALL)
              GROUP BY ALL)
        GROUP BY ALL""",
    ("straight",),
)
CTES["season_passes"] = (
    f"""
        SELECT {KEYS}, s, n, 0 AS k, [CAST(0 AS DOUBLE) for i in range(7)] AS week, [CAST(0 AS DOUBLE) for i in range(30)] AS month FROM phase_cells
        UNION ALL
        SELECT {KEYS}, s, n, k + 1, w,
               CASE WHEN analysis_id = 'ASIA' THEN month
                    ELSE [coalesce(list_sum([s[a][b] - n[a][b] * w[a] for a in range(1, 8)]) / nullif(list_sum([n[a][b] for a in range(1, 8)]), 0), 0) for b in range(1, 31)] END
        FROM (SELECT * EXCLUDE raw, [v - list_avg(raw) for v in raw] AS w
              FROM (SELECT *, [coalesce(list_sum([s[a][b] - n[a][b] * month[b] for b in range(1, 31)]) / nullif(list_sum(n[a]), 0), 0) for a in range(1, 8)] AS raw
                    FROM season_passes WHERE k < {SEASON_PASSES}))""",
    ("phase_cells",),
)
CTES["season_effects"] = (
    f"""
        SELECT {KEYS}, 7 AS period, unnest(range(7)) AS phase, unnest(week) AS effect FROM season_passes WHERE k = {SEASON_PASSES}
        UNION ALL
        SELECT {KEYS}, 30, unnest(range(30)), unnest(month) FROM season_passes WHERE k = {SEASON_PASSES} AND analysis_id <> 'ASIA'""",
    ("season_passes",),
)
CTES["orders_found"] = (
    f"""
        SELECT {KEYS}, CASE WHEN run_kind = 'main' THEN 1 ELSE coalesce(min(lag) FILTER (lag >= 2 AND abs(pacf) < 0.02), 41) - 1 END AS p
        FROM pacf GROUP BY {KEYS}""",
    ("pacf",),
)


def _carried(suffix: str, series: str) -> None:
    """``carried{suffix}``: the days after a series, from the coefficients of the order found."""
    levinson = f"levinson{suffix}"
    if suffix:
        CTES[f"lag_sums{suffix}"] = (acf_lists(series, "value", 40), (series,))
        CTES[levinson] = (CTES["levinson"][0].replace("FROM lag_sums)", f"FROM lag_sums{suffix})").replace("FROM levinson ", f"FROM {levinson} "), (f"lag_sums{suffix}",))
    CTES[f"carry{suffix}"] = (
        f"""
        SELECT {KEYS}, cs, p, phi, centre, last, 0 AS h, CAST(NULL AS DOUBLE) AS ahead
        FROM (SELECT {KEYS}, any_value(cs) AS cs, avg(value) AS centre, list(value - c ORDER BY d DESC) AS last
              FROM (SELECT *, avg(value) OVER (PARTITION BY {KEYS}) AS c FROM {series}) GROUP BY {KEYS})
        JOIN orders_found USING ({KEYS}) JOIN (SELECT {KEYS}, k, phi FROM {levinson}) v USING ({KEYS}) WHERE k = p
        UNION ALL
        SELECT {KEYS}, cs, p, phi, centre, list_prepend(a, last[1:p]), h + 1, a
        FROM (SELECT *, list_sum([coalesce(phi[i] * last[i], 0.0) for i in range(1, p + 1)]) AS a FROM carry{suffix}
              WHERE h <= (SELECT max(e - r.cs) FROM runs r))""",
        (series, levinson, "orders_found", "runs"),
    )
    CTES[f"carried{suffix}"] = (
        f"SELECT {KEYS}, c.cs + CAST(h - 1 AS INTEGER) AS d, centre + ahead AS forecast FROM carry{suffix} c JOIN runs r USING ({KEYS}) WHERE h BETWEEN 1 AND r.e - r.cs + 1",
        (f"carry{suffix}", "runs"),
    )


_carried("", "target")
CTES["seasoned"] = (
    f"""
        SELECT x.*, coalesce(w.effect, 0) AS weekly, coalesce(m.effect, 0) AS monthly, rest - coalesce(w.effect, 0) - coalesce(m.effect, 0) AS remains
        FROM straight x
        LEFT JOIN season_effects w ON w.analysis_id = x.analysis_id AND w.run_kind = x.run_kind AND w.period = 7 AND w.phase = number % 7
        LEFT JOIN season_effects m ON m.analysis_id = x.analysis_id AND m.run_kind = x.run_kind AND m.period = 30 AND m.phase = number % 30""",
    ("straight", "season_effects"),
)
CTES["features_left"] = (
    f"""
        SELECT f.* REPLACE (CASE WHEN role = 'target' THEN remains ELSE f.value END AS value)
        FROM features f JOIN (SELECT {KEYS}, d, remains FROM seasoned) USING ({KEYS}, d)""",
    ("features", "seasoned"),
)
_sparse("_left", "features_left")
CTES["last_rest"] = (f"SELECT {KEYS}, cs, d, remains - p.value AS value FROM seasoned s JOIN part_left p USING ({KEYS}, d) WHERE d < cs", ("seasoned", "part_left"))
_carried("_left", "last_rest")
CTES["split"] = (
    f"""
        SELECT {KEYS}, d, line, weekly, monthly, p.value AS regressors, coalesce(forecast, 0) AS autoregression
        FROM seasoned s JOIN part_left p USING ({KEYS}, d) LEFT JOIN carried_left USING ({KEYS}, d)""",
    ("seasoned", "part_left", "carried_left"),
)
RECURSIVE = ("levinson", "ur_steps", "descent", "season_passes")


def _with(final: str, *names: str) -> str:
    """Prefix ``final`` with the named expressions and all they depend on, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return final
    keyword = "WITH RECURSIVE" if any(n.startswith(RECURSIVE) for n in ordered) else "WITH"
    return keyword + ",\n".join(f" {n} AS ({CTES[n][0]})" for n in ordered) + "\n" + final


def _role_rows(role: str, column: str) -> str:
    return _with(
        f"SELECT analysis_id, {day('d')} AS reference_date, dim AS campaign_dimension, {r('value')} AS {column} FROM one",
        "one_" + role,
    ).replace("FROM one", "FROM one_" + role)


for _role in ("target", "control", "visitor", "click", "impression", "npc"):
    CTES["one_" + _role] = (series_of(_role), ("panel", "daily"))


def _perimeter_rows(condition: str) -> str:
    return _with(
        f"""SELECT analysis_id, {day('d')} AS reference_date, country_code AS campaign_dimension,
                   CAST(sum(metric) AS DOUBLE) AS metric
            FROM fact JOIN panel ON country_code = target
            WHERE d BETWEEN data_s AND e AND ({condition}) GROUP BY analysis_id, d, country_code""",
        "fact", "panel",
    )


def _case_rows(source: str, column: str, digits: int = 4) -> str:
    return f"SELECT analysis_id, 'covid' AS role, '' AS campaign_dimension, {day('d')} AS reference_date, {r(column, digits)} AS value FROM {source}"


def _period_status(first: str, last: str, yearly: str) -> str:
    pre = f"({first} + INTERVAL 6 MONTHS <= cs)"
    post = f"(datediff('day', cs, {last}) >= 10)"
    year = f"({first} + INTERVAL 24 MONTHS <= cs)" if yearly == "true" else "true"
    return f"""{day(first)} AS first_day, {day(last)} AS last_day, {pre} AS pre_ok, {post} AS post_ok,
               {year} AS yearly_ok, CASE WHEN {pre} AND {post} AND {year} THEN 'ok' ELSE 'period too short' END AS status"""


def _bounds(prefix: str, digits: int, columns: dict[str, str]) -> str:
    return ", ".join(f"{r(c, digits)} AS {prefix}_{name}" for name, c in columns.items())


STATS = f"""
    SELECT {KEYS}, count(*) AS n, min(error) AS lo, (max(error) - min(error)) / 20 AS width,
           avg(error) AS centre, stddev_pop(error) AS spread FROM resid GROUP BY {KEYS}"""
NORMAL_DENSITY = "exp(-pow(({0} - centre) / spread, 2) / 2) / (spread * sqrt(2 * pi()))"


def _report_line(i: int, label: str, cells) -> str:
    return f"SELECT {KEYS}, {i} AS line, {label} AS label, {cells('average')} AS average, {cells('cumulative')} AS cumulative FROM wide_summary"


def _two(expr: str) -> str:
    return f"printf('%.2f', {expr})"


def _value_cell(q: str, unit: str):
    return lambda p: f"{_two(f'{q}_{p}')} || '{unit} (' || {_two(_sd(q, p))} || '{unit})'"


def _bounds_cell(q: str, unit: str):
    return lambda p: f"'[' || {_two(f'{q}_lower_{p}')} || '{unit}, ' || {_two(f'{q}_upper_{p}')} || '{unit}]'"


REPORT = " UNION ALL ".join(
    [
        _report_line(0, "'Actual'", lambda p: _two(f"actual_{p}")),
        _report_line(1, "'Prediction (s.d.)'", _value_cell("predicted", "")),
        _report_line(2, "'95% CI'", _bounds_cell("predicted", "")),
        _report_line(3, "'Absolute effect (s.d.)'", _value_cell("abs_effect", "")),
        _report_line(4, "'95% CI'", _bounds_cell("abs_effect", "")),
        _report_line(5, "'Relative effect (s.d.)'", _value_cell("rel_effect", "%")),
        _report_line(6, "'95% CI'", _bounds_cell("rel_effect", "%")),
    ]
)

STATUSES = ("F", "O", "P")  # fixed values of the test tables
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE_EAST")


def _wide(source: str, columns) -> str:
    picks = ", ".join(f"{r(f'sum(value) FILTER (feature = {c!r})')} AS {c}" for c in columns)
    return f"SELECT {KEYS}, {day('d')} AS reference_date, {picks} FROM {source} GROUP BY {KEYS}, d"


PERIOD = "CASE WHEN d < cs THEN 'pre' ELSE 'post' END"
FEATURE_ROW = f"{KEYS}, {day('cs')} AS campaign_start, role, feature, {day('d')} AS reference_date, {r('value')} AS value"

SUMMARY_SHOWN = f"SELECT {KEYS}, quantity_ord, quantity, " + ", ".join(
    f"CASE WHEN quantity LIKE 'rel%' THEN {r(c, 6)} ELSE {r(c, digits)} END AS {c}"
    for c, digits in (("average", 4), ("cumulative", 2))
)

ORACLES: dict[str, str] = {
    "read_fact_range": f"""
        SELECT l_orderkey, l_partkey, {day('CAST(l_shipdate AS DATE)')} AS day, l_quantity, l_extendedprice
        FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
    "month_bounds": _with(
        f"""SELECT analysis_id, {day("CAST(date_trunc('month', data_s) AS DATE)")} AS month_start,
                   {day('last_day(e)')} AS month_end FROM supplier_data""",
        "supplier_data",
    ),
    "month_ranges": _with(
        f"""SELECT analysis_id, {day('m')} AS month_start, {day('last_day(m)')} AS month_end
            FROM (SELECT analysis_id, CAST(unnest(generate_series(date_trunc('month', CAST(data_s AS TIMESTAMP)),
                         date_trunc('month', CAST(e AS TIMESTAMP)), INTERVAL 1 MONTH)) AS DATE) AS m FROM supplier_data)""",
        "supplier_data",
    ),
    "disabled_role_empty": _with(
        "SELECT analysis_id, role, count(*) AS days FROM one_any GROUP BY 1, 2", "base_series", "one_click"
    ).replace("FROM one_any", "FROM (SELECT * FROM base_series UNION ALL SELECT * FROM one_click)"),
    "target_daily": _role_rows("target", "metric"),
    "target_in_perimeter": _perimeter_rows(PERIMETER),
    "target_out_perimeter": _perimeter_rows(f"NOT coalesce({PERIMETER}, false)"),
    "target_out_perimeter_as_written": _perimeter_rows(
        "channel <> 'BUILDING' OR account_name <> 'F' OR subchannel = '1-URGENT'"
    ),
    "control_daily": _role_rows("control", "metric"),
    "visitor_daily": _role_rows("visitor", "visitor"),
    "click_daily": _role_rows("click", "click"),
    "impression_daily": _role_rows("impression", "impression"),
    "npc_daily": _role_rows("npc", "npc"),
    "payment_daily": f"""
        SELECT event_type AS analysis_id, {day('CAST(ts AS DATE)')} AS reference_date,
               event_type AS campaign_dimension, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS metric
        FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2023-12-30' AND DATE '2024-01-30'
        GROUP BY event_type, CAST(ts AS DATE)""",
    "user_sql_extract": _with(
        f"""SELECT {day('d')} AS reference_date, country_code AS campaign_dimension, CAST(sum(metric) AS DOUBLE) AS metric
            FROM fact WHERE d BETWEEN DATE '1997-10-01' AND DATE '2000-08-31' AND country_code IN ('AFRICA', 'ASIA')
            GROUP BY d, country_code""",
        "fact",
    ),
    "run_windows": _with(
        f"""SELECT {KEYS}, {day('s')} AS start, {day('cs')} AS campaign_start, {day('e')} AS "end" FROM ({shifted('supplier_windows')})""",
        "supplier_windows",
    ),
    "daily_spine": _with(
        f"""SELECT {KEYS}, {day('cs')} AS campaign_start, {day('d')} AS reference_date
            FROM (SELECT {KEYS}, cs, {each_day('s', 'e')} AS d FROM ({shifted('region_life')}))""",
        "fact",
    ).replace("region_life", "(SELECT country_code AS analysis_id, min(d) AS s, max(d) - 90 AS cs, max(d) AS e FROM fact GROUP BY 1)"),
    "week_bounds": f"""
        SELECT {day('d')} AS day, count(*) AS orders, {day(WEEK_START.format('d'))} AS week_start,
               {day(WEEK_END.format('d'))} AS week_end
        FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY d""",
    "month_slices": _with(
        f"""SELECT analysis_id, {day('a')} AS slice_start, {day('b')} AS slice_end, {day('a')} || ' ' || {day('b')} AS timeframe
            FROM (SELECT analysis_id, greatest(m, lo) AS a, least(last_day(m), hi) AS b
                  FROM (SELECT analysis_id, lo, hi, CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)),
                               date_trunc('month', CAST(hi AS TIMESTAMP)), INTERVAL 1 MONTH)) AS DATE) AS m
                        FROM (SELECT analysis_id, {WEEK_START.format('data_s')} AS lo, {WEEK_END.format('e')} AS hi
                              FROM supplier_data)))""",
        "supplier_data",
    ),
    "month_labels": f"""
        SELECT {MONTH_KEY.format('o_orderdate')} AS month, monthname(o_orderdate) AS month_name, count(*) AS orders
        FROM orders GROUP BY 1, 2""",
    "period_labels": _with(
        f"SELECT {KEYS}, {PERIOD} AS period, count(*) AS rows, {r('sum(value)')} AS total FROM features GROUP BY ALL",
        "features",
    ),
    "period_check": _with(
        f"""SELECT {KEYS}, {_period_status('f', 'l', 'true')}
            FROM (SELECT {KEYS}, cs, min(d) AS f, max(d) AS l FROM clean WHERE role = 'target' GROUP BY {KEYS}, cs)""",
        "clean",
    ),
    "period_check_short": f"""
        SELECT {KEYS}, {_period_status('s', 'e', 'false')}
        FROM ({shifted("(SELECT DISTINCT event_type AS analysis_id, DATE '2024-01-08' AS s, DATE '2024-01-22' AS cs, DATE '2024-01-30' AS e FROM events)")})""",
    "interest_scale": _with(
        f"SELECT analysis_id, keyword, month, {r('month_sum', 6)} AS month_sum, {r('scale_factor', 6)} AS scale_factor FROM scale",
        "scale",
    ),
    "interest_rescaled": _with(
        f"SELECT analysis_id, keyword, {day('d')} AS reference_date, {r('value', 6)} AS value FROM rescaled", "rescaled"
    ),
    "interest_all": _with(
        f"""SELECT analysis_id, 'gtrend' AS role, keyword AS campaign_dimension, {day('d')} AS reference_date,
                   {r('value', 6)} AS value FROM rescaled""",
        "rescaled",
    ),
    "interest_smoothed": _with(
        f"""SELECT analysis_id, 'gtrend' AS role, keyword AS campaign_dimension, {day('d')} AS reference_date,
                   {r('avg(value) OVER (PARTITION BY analysis_id, keyword ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)', 6)} AS value
            FROM rescaled WHERE value IS NOT NULL AND keyword <> 'global_brand'
            UNION ALL
            SELECT analysis_id, 'gtrend', keyword, {day('d')}, {r('value', 6)} FROM rescaled WHERE keyword = 'global_brand'""",
        "rescaled",
    ),
    "exog_daily_sum": _with(f"SELECT target, {day('d')} AS reference_date, cases FROM totals_whole", "totals_whole"),
    "exog_new_cases": _with(f"SELECT target, {day('d')} AS reference_date, cases, new_cases FROM new_cases_whole", "new_cases_whole"),
    "exog_filled": _with(_case_rows("filled", "value"), "filled"),
    "exog_smoothed": _with(
        _case_rows(
            "filled",
            "CASE WHEN value IS NOT NULL THEN avg(value) OVER (PARTITION BY analysis_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) END",
        ),
        "filled",
    ),
    "exog_edges_filled": _with(
        f"SELECT analysis_id AS target, {day('d')} AS reference_date, value AS new_cases FROM full_filled", "full_filled"
    ),
    "features_long": _with(f"SELECT {FEATURE_ROW} FROM all_features", "all_features"),
    "features_wide": _with(
        _wide("visit_features", [f"{p}{x}" for p in ("metric_in_perim_", "metric_", "visitor_") for x in REGIONS]),
        "visit_features",
    ),
    "holiday_flag": _with(
        f"""SELECT {KEYS}, {day('cs')} AS campaign_start, 'flag_holiday' AS feature, {day('d')} AS reference_date,
                   CASE WHEN strftime(d, '%m-%d') IN ('01-01', '05-01', '12-25')
                         AND year(d) BETWEEN (SELECT year(lo) FROM extent) AND (SELECT year(hi) FROM extent)
                        THEN 1.0 ELSE 0.0 END AS value
            FROM spine""",
        "spine", "extent",
    ),
    "month_dummies": _with(
        f"""SELECT {KEYS}, {day('d')} AS reference_date, value, """
        + ", ".join(f"CASE WHEN monthname(d) = '{m}' THEN 1.0 ELSE 0.0 END AS month_{m}" for m in MONTHS)
        + " FROM features WHERE role = 'target'",
        "features",
    ),
    "one_hot_levels": "SELECT o_orderkey, "
    + ", ".join(f"""CASE WHEN o_orderstatus = '{x}' THEN 1 ELSE 0 END AS "o_orderstatus_{x}" """ for x in STATUSES)
    + ", "
    + ", ".join(f"""CASE WHEN o_orderpriority = '{x}' THEN 1 ELSE 0 END AS "o_orderpriority_{x}" """ for x in PRIORITIES)
    + " FROM orders",
    "dead_features": _with(f"SELECT {KEYS}, feature, 'pre-period sum is 0' AS reason FROM dead", "dead"),
    "flat_head_trim": _with(f"SELECT {KEYS}, {day('flat_until')} AS flat_until FROM head", "head"),
    "clean_features": _with(f"SELECT {FEATURE_ROW} FROM clean", "clean"),
    "input_series": _with(
        f"""SELECT {KEYS}, role, feature, {day('d')} AS reference_date, {r('value')} AS value
            FROM visit_features WHERE role IN ('target', 'visitor')""",
        "visit_features",
    ),
    "target_bounds": _with(
        f"""SELECT {KEYS}, {r('min(value)')} AS min_value, {r('max(value)')} AS max_value
            FROM features WHERE role = 'target' GROUP BY {KEYS}""",
        "features",
    ),
    "target_acf": _with(
        f"""SELECT {KEYS}, lag, {r('s / nullif(s0, 0)', 6)} AS acf
            FROM (SELECT {KEYS}, CAST(unnest(range(0, 41)) AS INTEGER) AS lag, unnest(g) AS s, g[1] AS s0 FROM lag_sums)""",
        "lag_sums",
    ),
    "target_pacf": _with(
        f"SELECT {KEYS}, CAST(lag AS INTEGER) AS lag, {r('pacf', 6)} AS pacf FROM pacf", "pacf"
    ),
    "variance_status": _with(
        f"""SELECT {KEYS}, CASE WHEN stddev_pop(CASE WHEN run_kind = 'spec' THEN 0.0 ELSE value END) = 0
                                THEN 'target has no variance' ELSE 'ok' END AS status
            FROM target GROUP BY {KEYS}""",
        "target",
    ),
    "pct_change": _with(
        f"SELECT {KEYS}, role, feature, {day('d')} AS reference_date, {r('change', 6)} AS change FROM changes", "changes"
    ),
    "sparse_changes": _with(
        f"SELECT {KEYS}, role, feature, {r('missing_share', 6)} AS missing_share, missing_share >= 0.4 AS is_sparse FROM shares",
        "shares",
    ),
    "target_corr": _with(
        f"""SELECT {KEYS}, feature, {r('c', 6)} AS correlation,
                   CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC NULLS LAST, feature) AS INTEGER) AS rank
            FROM (
                SELECT {KEYS}, feature, abs(corr(change, tc)) AS c
                FROM (
                    SELECT k.*, count(*) FILTER (change IS NULL) OVER (PARTITION BY {KEYS}, d) AS holes,
                           max(change) FILTER (role = 'target') OVER (PARTITION BY {KEYS}, d) AS tc
                    FROM (SELECT c.* FROM changes c JOIN shares s USING (analysis_id, run_kind, feature)
                          WHERE s.missing_share < 0.4 OR c.role = 'target') k)
                WHERE holes = 0 AND tc IS NOT NULL AND role <> 'target' GROUP BY {KEYS}, feature)""",
        "changes", "shares",
    ),
    "weekly_seasonal": _with(
        f"""SELECT {KEYS}, {day('d')} AS reference_date, {r('value', 2)} AS value, {r('trend', 2)} AS trend,
                   {r('seasonal', 2)} AS seasonal, {r('value - seasonal', 2)} AS deseasonal FROM seasonal""",
        "seasonal",
    ),
    "adf": _with(
        f"""SELECT {KEYS}, {r('tau', 6)} AS statistic, {r('p_value', 6)} AS p_value, used_lag,
                   CASE WHEN p_value < 0.01 THEN 'Stationary' ELSE 'Not stationary' END AS verdict FROM adf""",
        "adf",
    ),
    "trend_candidates": _with(
        f"""SELECT {KEYS}, CAST(ord AS INTEGER) AS candidate_ord, candidate
            FROM (SELECT {KEYS}, unnest(names) AS candidate, unnest(range(len(names))) AS ord
                  FROM (SELECT {KEYS}, CASE WHEN analysis_id = 'ASIA' THEN ['semi_local_linear'] WHEN p_value < 0.01 THEN ['no_trend']
                                            ELSE ['local_level', 'local_linear', 'semi_local_linear'] END AS names FROM adf_total))""",
        "adf_total",
    ),
    "gram": _with(
        f"SELECT {KEYS}, feature_i, feature_j, {r('product')} AS product FROM gram WHERE (oi, feature_i) <= (oj, feature_j)", "gram"
    ),
    "sparse_fit": _with(f"SELECT {KEYS}, feature, {r('coefficient', 6)} AS coefficient, {r('product', 6)} AS product FROM fit", "fit"),
    "importance": _with(
        f"""SELECT {KEYS}, feature, {r('abs(coefficient)', 6)} AS importance,
                   CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY round(abs(coefficient), 9) DESC, feature) AS INTEGER) AS rank,
                   {r(f"coefficient * product / nullif(sum(coefficient * product) OVER (PARTITION BY {KEYS}), 0)", 6)} AS share
            FROM fit""",
        "fit",
    ),
    "all_controls_fit": _with(
        f"""SELECT {KEYS}, {day('cs')} AS campaign_start, {day('d')} AS reference_date, {r('observed', 2)} AS observed, {r('mean', 2)} AS mean,
                   {r(f'mean - {Z!r} * sd', 2)} AS lower, {r(f'mean + {Z!r} * sd', 2)} AS upper, {r('sd', 2)} AS sd FROM together""",
        "together",
    ),
    "two_seasons": _with(
        f"SELECT {KEYS}, CAST(period AS INTEGER) AS period, CAST(phase AS INTEGER) AS phase, {r('effect')} AS effect FROM season_effects", "season_effects"
    ),
    "ar_forecast": _with(f"SELECT {KEYS}, {day('d')} AS reference_date, {r('forecast')} AS forecast FROM carried", "carried"),
    "components": _with(
        f"""SELECT {KEYS}, {day('d')} AS reference_date, component, {r('value', 2)} AS value, {r('mean', 2)} AS mean
            FROM (SELECT {KEYS}, d, {' + '.join(COMPONENTS)} AS mean, unnest([{', '.join(f"'{c}'" for c in COMPONENTS)}]) AS component,
                         unnest([{', '.join(COMPONENTS)}]) AS value FROM split)""",
        "split",
    ),
    "ar_order": _with(
        f"""SELECT {KEYS}, CAST(CASE WHEN run_kind = 'main' THEN 1
                   ELSE coalesce(min(lag) FILTER (lag >= 2 AND abs(pacf) < 0.02), 41) - 1 END AS INTEGER) AS ar_order
            FROM pacf GROUP BY {KEYS}""",
        "pacf",
    ),
    "standardized": _with(
        f"SELECT {KEYS}, feature, {day('d')} AS reference_date, {r('scaled', 6)} AS scaled FROM scaled", "scaled"
    ),
    "hyperpriors": _with(
        f"""SELECT {KEYS}, {r('m * m / (s * s) + 2', 6)} AS prior_alpha, {r('m * (m * m / (s * s) + 1)', 6)} AS prior_beta
            FROM (
                SELECT {KEYS}, abs(avg(z) FILTER (d < cs)) AS m, stddev_pop(z) FILTER (d < cs) * 0.1 AS s
                FROM (SELECT {KEYS}, cs, d, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z
                      FROM features WHERE role = 'target' WINDOW w AS (PARTITION BY {KEYS}))
                GROUP BY {KEYS})""",
        "features",
    ),
    "design_moments": _with(
        f"""SELECT x.analysis_id, x.run_kind, x.feature, count(*) AS n, {r('sum(x.scaled * x.scaled)')} AS xx,
                   {r('sum(x.scaled * y.scaled)')} AS xy
            FROM scaled x JOIN scaled y
              ON y.role = 'target' AND y.analysis_id = x.analysis_id AND y.run_kind = x.run_kind AND y.d = x.d
            WHERE x.role <> 'target' AND x.d < x.cs GROUP BY 1, 2, 3""",
        "scaled",
    ),
    "single_control_fit": _with(
        f"""SELECT {KEYS}, {day('cs')} AS campaign_start, {day('d')} AS reference_date, {r('observed', 2)} AS observed,
                   {r('mean', 2)} AS mean, {r('lower', 2)} AS lower, {r('upper', 2)} AS upper, {r('sd', 2)} AS sd FROM pred""",
        "pred",
    ),
    "inference_errors": _with(
        f"""SELECT {KEYS}, {day('d')} AS reference_date, {r('error', 2)} AS error, {r('perc_error', 6)} AS perc_error
            FROM effect""",
        "effect",
    ),
    "candidate_mape": _with(
        f"SELECT {KEYS}, candidate, mape, CAST(candidate_ord AS INTEGER) AS candidate_ord FROM scores", "scores"
    ),
    "candidate_mape_pre": _with(
        f"""SELECT {KEYS}, candidate, {r('avg(abs((observed - mean) / nullif(observed, 0)))', 6)} AS mape
            FROM regression WHERE d < cs GROUP BY {KEYS}, candidate""",
        "regression",
    ),
    "selected_model": _with(
        f"SELECT {KEYS}, candidate, mape, CAST(candidate_ord AS INTEGER) AS candidate_ord FROM winner", "winner"
    ),
    "point_effects": _with(
        f"SELECT {KEYS}, {day('d')} AS reference_date, {_bounds('point_effects', 2, {'means': 'pm', 'lower': 'pl', 'upper': 'pu'})} FROM effect",
        "effect",
    ),
    "cumulative_effects": _with(
        f"SELECT {KEYS}, {day('d')} AS reference_date, {_bounds('post_cum_effects', 1, {'means': 'cm', 'lower': 'cl', 'upper': 'cu'})} FROM effect",
        "effect",
    ),
    "effect_summary": _with(
        SUMMARY_SHOWN + " FROM summary",
        "summary",
    ),
    "effect_sd": _with(
        " UNION ALL ".join(
            f"SELECT {KEYS}, '{q}' AS quantity, {_sd(q, 'average')} AS average, {_sd(q, 'cumulative')} AS cumulative FROM wide_summary"
            for q in ("predicted", "abs_effect", "rel_effect")
        ),
        "wide_summary",
    ),
    "effect_report": _with(REPORT, "wide_summary"),
    "effect_probability": _with(
        f"""SELECT {KEYS}, {r('p_value', 6)} AS p_value, CAST(ceil((1 - {r('p_value', 6)}) * 100) AS BIGINT) AS probability
            FROM p_values""",
        "p_values",
    ),
    "plot_bounds": _with(
        f"""SELECT {KEYS},
                   {r('least(min(observed), min(mean), min(lower))', 2)} AS min_observed,
                   {r('greatest(max(observed), max(mean), max(upper))', 2)} AS max_observed,
                   {r('least(min(pm), min(pl))', 2)} AS min_point, {r('greatest(max(pm), max(pu))', 2)} AS max_point,
                   {r('least(min(cm), min(cl))', 2)} AS min_cumulative, {r('greatest(max(cm), max(cu))', 2)} AS max_cumulative
            FROM effect GROUP BY {KEYS}""",
        "effect",
    ),
    "residuals": _with(
        f"""SELECT {KEYS}, {day('d')} AS reference_date, {r('observed', 2)} AS observed, {r('error', 2)} AS error,
                   {r('perc_error', 6)} AS perc_error FROM effect WHERE d < cs""",
        "effect",
    ),
    "residual_hist": _with(
        f"""SELECT b.analysis_id, b.run_kind, b.bin, {r('b.middle', 6)} AS bin_centre, coalesce(c.rows, 0) AS rows,
                   {r('coalesce(c.rows, 0) / (b.n * b.width)', 12)} AS density,
                   {r(NORMAL_DENSITY.format('b.middle'), 12)} AS normal_density
            FROM (SELECT *, lo + (bin + 0.5) * width AS middle
                  FROM (SELECT *, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM ({STATS}))) b
            LEFT JOIN (
                SELECT analysis_id, run_kind, CAST(least(floor((error - lo) / width), 19) AS INTEGER) AS bin, count(*) AS rows
                FROM resid JOIN ({STATS}) USING (analysis_id, run_kind) GROUP BY 1, 2, 3) c
              ON c.analysis_id = b.analysis_id AND c.run_kind = b.run_kind AND c.bin = b.bin""",
        "resid",
    ),
    "residual_density": _with(
        f"""SELECT {KEYS}, {day('d')} AS reference_date, {r('error', 2)} AS error,
                   {r(NORMAL_DENSITY.format('error'), 12)} AS normal_density
            FROM resid JOIN ({STATS}) USING (analysis_id, run_kind)""",
        "resid",
    ),
    "residual_acf": _with(
        f"""SELECT {KEYS}, lag, {r('s / nullif(s0, 0)', 6)} AS acf
            FROM (SELECT {KEYS}, CAST(unnest(range(0, 11)) AS INTEGER) AS lag, unnest(g) AS s, g[1] AS s0
                  FROM ({acf_lists('resid', 'error', 10)}))""",
        "resid",
    ),
    "relative_error": _with(
        f"SELECT {KEYS}, {r('avg(error) / nullif(avg(observed), 0)', 8)} AS relative_error FROM resid GROUP BY {KEYS}",
        "resid",
    ),
    "qq_points": _with(
        f"""SELECT {KEYS}, rn, {r('t', 6)} AS theoretical, {r('error', 2)} AS observed, {r('my + slope * (t - mx)', 2)} AS fitted
            FROM (
                SELECT *, regr_slope(error, t) OVER w AS slope, avg(error) OVER w AS my, avg(t) OVER w AS mx
                FROM (
                    SELECT *, {quantile('m')} AS t
                    FROM (
                        SELECT *, CASE WHEN rn = n THEN pow(0.5, 1.0 / n) WHEN rn = 1 THEN 1 - pow(0.5, 1.0 / n)
                                       ELSE (rn - 0.3175) / (n + 0.365) END AS m
                        FROM (SELECT {KEYS}, error, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY error, d) AS INTEGER) AS rn,
                                     count(*) OVER (PARTITION BY {KEYS}) AS n FROM resid)))
                WINDOW w AS (PARTITION BY {KEYS}))""",
        "resid",
    ),
    "placebo_summary": _with(
        SUMMARY_SHOWN + " FROM summary WHERE run_kind = 'spec'",
        "summary",
    ),
    "placebo_verdict": _with(
        f"""SELECT analysis_id, {r('p_value', 6)} AS p_value,
                   CASE WHEN 1 - p_value >= 0.95 THEN 'Negative' ELSE 'Positive' END AS specificity_test
            FROM p_values WHERE run_kind = 'spec'""",
        "p_values",
    ),
    "placebo_fit_plan": _with(
        "SELECT analysis_id, 'spec' AS run_kind, 0 AS candidate_ord, candidate FROM winner WHERE run_kind = 'main'",
        "winner",
    ),
    "csv_accepted": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS reference_date, CAST(o_orderkey % 1000 AS DOUBLE) AS cases
        FROM orders
        WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('2-HIGH', '4-NOT SPECIFIED', '5-LOW') AND o_orderkey % 10 <> 0""",
    "csv_rejected": """SELECT o_custkey || ',' || CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END
               || CASE WHEN o_orderpriority = '2-HIGH' THEN ''
                       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ',' || (o_orderkey % 1000) || ',more'
                       WHEN o_orderpriority = '5-LOW' THEN ',n/a'
                       WHEN o_orderkey % 10 = 0 THEN ','
                       ELSE ',' || (o_orderkey % 1000) END AS line,
               CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN 'malformed'
                    WHEN o_orderstatus = 'P' THEN 'no day'
                    ELSE 'no number' END AS reason
        FROM orders
        WHERE o_orderstatus = 'P' OR o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED', '5-LOW') OR o_orderkey % 10 = 0""",
    "run_listing": "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS analysis_id FROM lineitem",
    "run_exists": _with(
        """SELECT analysis_id, analysis_id IN (SELECT r_name FROM region) AS taken
           FROM (SELECT channel AS analysis_id FROM fact UNION SELECT country_code FROM fact)""",
        "fact",
    ),
}


ORACLES["panel_runs"] = _with(
    f"""SELECT u.analysis_id, u.run_kind, u.analysis_id AS target, {day('s.f')} AS start, {day('u.cs')} AS campaign_start,
               {day('s.l')} AS "end", false AS monthly_seasonality, false AS yearly_seasonality, true AS fix_order,
               0.05 AS alpha, c.candidate AS model_name, CAST(1 AS INTEGER) AS ar_order, {r('c.mape')} AS mape,
               {r('p.p_value')} AS p_value,
               CASE WHEN u.run_kind = 'main' AND q.p_value IS NOT NULL
                    THEN CASE WHEN 1 - q.p_value >= 0.95 THEN 'Negative' ELSE 'Positive' END END AS specificity_test,
               CASE WHEN s.status <> 'ok' THEN s.status WHEN c.candidate IS NULL THEN 'no candidate' ELSE 'ok' END AS status
        FROM runs u LEFT JOIN status0 s USING ({KEYS}) LEFT JOIN chosen0 c USING ({KEYS}) LEFT JOIN p0 p USING ({KEYS})
        LEFT JOIN p0 q ON q.analysis_id = u.analysis_id AND q.run_kind = 'spec'""",
    "runs", "status0", "chosen0", "p0",
)


ORACLES["control_daily_repeated"] = ORACLES["control_daily"]
ORACLES["interest_repeated"] = ORACLES["interest_smoothed"]
ORACLES["corr_status"] = _with(
    f"""SELECT {KEYS}, {r('missing_share', 6)} AS missing_share,
               CASE WHEN missing_share >= 0.4 THEN 'target too sparse' ELSE 'ok' END AS status
        FROM shares WHERE role = 'target'""",
    "shares",
)
ORACLES["stage_replaced"] = _with(
    f"""SELECT {KEYS}, role, feature, {day('d')} AS reference_date,
               {r("CASE WHEN analysis_id = 'ASIA' THEN value / 2 ELSE value END")} AS value
        FROM features WHERE analysis_id <> 'EUROPE'""",
    "features",
)


def _for_nations(sql: str) -> str:
    """The same query with nations in the place of regions."""
    return (
        sql.replace("r_name AS country_code", "n_name AS country_code")
        .replace("r_name AS analysis_id, r_name AS target", "n_name AS analysis_id, n_name AS target")
        .replace("FROM region)", "FROM nation)")
    )


ORACLES["nation_effect_summary"] = _for_nations(ORACLES["effect_summary"])
ORACLES["stored_replaced"] = ORACLES["stage_replaced"]
ORACLES["stored_acf"] = ORACLES["target_acf"]
ORACLES["stored_corr"] = ORACLES["target_corr"]
ORACLES["run_deleted"] = f"SELECT * FROM ({ORACLES['panel_runs']}) AS saved WHERE NOT (analysis_id = 'ASIA' AND run_kind = 'main')"

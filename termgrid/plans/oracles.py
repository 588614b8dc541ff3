"""Equivalent SQL of the registered queries, over the same raw tables.

The texts run in DuckDB.  Each starts from the common beginnings below (raw
grade rows -> course-term metrics -> demand; raw rows -> stable panel -> lags),
so an oracle never reads anything a Spark query computed.
"""

from __future__ import annotations

from termgrid.functions.text import SPECIAL_TOPIC_PATTERN
from termgrid.plans.catalog import DIGITS, FLAGGED_PERIODS, STATES, SUBJECTS
from termgrid.spec import BAND_POINTS, BANDS, SHARES

YEARS = "(1996, 1997, 1998)"


def _r(column: str, name: str | None = None) -> str:
    return f"round({column}, {DIGITS}) AS {name or column}"


def _rs(*columns: str) -> str:
    return ", ".join(_r(c) for c in columns)


def _each(template: str, items=BANDS, glue: str = ", ") -> str:
    return glue.join(template.format(b=b) for b in items)


_BAND_CASES = ", ".join(
    f"CASE WHEN l_returnflag <> 'R' AND floor((l_quantity - 1) * 13 / 50) = {i} THEN l_quantity ELSE 0.0 END AS {b}"
    for i, b in enumerate(BANDS)
)
_POINTS = " + ".join(f"coalesce({b}, 0) * {p}::DOUBLE" for b, p in BAND_POINTS.items())
_TOTAL = _each("coalesce({b}, 0)", glue=" + ")

RAW = f"""
placed AS (
  SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'spring' WHEN p_partkey % 7 = 0 THEN 'fall'
      WHEN month(o_orderdate) <= 6 THEN 'spring' ELSE 'fall' END AS term,
    year(o_orderdate) + CASE WHEN p_partkey % 3 <> 1 OR year(o_orderdate) % 2 = 0 THEN 0
      WHEN year(o_orderdate) < 2000 THEN 1 ELSE -1 END AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), raw AS (
  SELECT year, term, year || CASE WHEN term = 'spring' THEN '-sp' ELSE '-fa' END AS year_term,
    p_brand AS subject, p_partkey::VARCHAR AS number,
    CASE WHEN p_name LIKE '%gizmo' OR l_linenumber = 7 THEN 'Special Topics: ' || p_name
         WHEN l_linestatus = 'O' THEN upper(p_name) || '!'
         WHEN l_discount >= 0.1 THEN p_name || ' II' ELSE p_name END AS title,
    l_linestatus AS sched_type, {_BAND_CASES},
    CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS w,
    CASE WHEN l_returnflag <> 'R' THEN nullif(l_quantity, 13.0) ELSE 0.0 END AS students,
    l_suppkey::VARCHAR AS instructor
  FROM placed
), scope AS (SELECT * FROM raw WHERE year IN {YEARS})"""

METRICS = RAW + f""", sums AS (
  SELECT year, term, subject, number, title, {_each("coalesce(sum({b}), 0) AS {b}")},
    coalesce(sum(w), 0) AS w, coalesce(sum(students), 0) AS students
  FROM scope GROUP BY year, term, subject, number, title
), totals AS (SELECT *, {_TOTAL} AS grade_total FROM sums
), m AS (
  SELECT *, CASE WHEN w + students > 0 THEN w / (w + students) END AS w_mark_share,
    CASE WHEN grade_total > 0 THEN ({_POINTS}) / grade_total END AS grade_point_mean,
    {_each("CASE WHEN grade_total > 0 THEN {b} / grade_total END AS share_{b}")}
  FROM totals
), d AS (
  SELECT *, CASE WHEN demand_proxy > 0 THEN w / demand_proxy END AS w_proxy FROM (
    SELECT *, CASE WHEN students >= 0 AND w >= 0 THEN students + w END AS demand_proxy FROM m)
)"""

DEMAND = METRICS + """, threshold AS (SELECT quantile_cont(demand_proxy, 0.75) AS t FROM d
), ranked AS (
  SELECT d.*, coalesce(demand_proxy >= t, false) AS is_high_demand,
    CASE WHEN demand_proxy IS NOT NULL THEN rank() OVER (ORDER BY demand_proxy DESC NULLS LAST) END AS demand_rank,
    coalesce(demand_proxy >= 20 AND w_proxy IS NOT NULL, false) AS w_proxy_rankable,
    CASE WHEN demand_proxy >= 20 AND w_proxy IS NOT NULL THEN rank() OVER (
      ORDER BY CASE WHEN demand_proxy >= 20 THEN w_proxy END DESC NULLS LAST) END AS w_proxy_rank
  FROM d, threshold
)"""

SUMMARY = DEMAND + """, grouped AS (
  SELECT subject, number, title, count(*) AS course_term_count, count(DISTINCT year) AS year_count,
    count(DISTINCT term) AS term_count, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years_observed,
    min(year) AS first_year, max(year) AS last_year, sum(students) AS students_total, sum(w) AS w_total,
    sum(demand_proxy) AS demand_proxy_total, avg(demand_proxy) AS demand_proxy_mean,
    median(demand_proxy) AS demand_proxy_median, max(demand_proxy) AS demand_proxy_max,
    avg(w_proxy) AS w_proxy_course_term_mean, max(w_proxy) AS w_proxy_course_term_max,
    count(demand_proxy) AS demand_valid_term_count, count(*) FILTER (WHERE is_high_demand) AS high_demand_term_count,
    count(DISTINCT year) FILTER (WHERE is_high_demand) AS high_demand_year_count,
    sum(w) FILTER (WHERE demand_proxy IS NOT NULL) AS w_valid
  FROM ranked GROUP BY subject, number, title
), weighted AS (
  SELECT *, CASE WHEN demand_proxy_total > 0 THEN w_valid / demand_proxy_total END AS w_proxy_weighted,
    CASE WHEN demand_valid_term_count > 0 THEN high_demand_term_count / demand_valid_term_count END AS high_demand_share
  FROM grouped
), summary AS (
  SELECT *, CASE WHEN demand_proxy_total IS NOT NULL THEN rank() OVER (ORDER BY demand_proxy_total DESC NULLS LAST) END AS demand_total_rank,
    CASE WHEN demand_proxy_mean IS NOT NULL THEN rank() OVER (ORDER BY demand_proxy_mean DESC NULLS LAST) END AS demand_mean_rank,
    coalesce(demand_proxy_total >= 20 AND w_proxy_weighted IS NOT NULL, false) AS w_proxy_rankable,
    CASE WHEN demand_proxy_total >= 20 AND w_proxy_weighted IS NOT NULL THEN rank() OVER (
      ORDER BY CASE WHEN demand_proxy_total >= 20 THEN w_proxy_weighted END DESC NULLS LAST) END AS w_proxy_weighted_rank
  FROM weighted
)"""

_HISTORY = {
    "historical_w_proxy_mean": "w_proxy", "historical_demand_proxy_mean": "demand_proxy",
    "historical_students_mean": "students", "historical_grade_total_mean": "grade_total",
    **{f"historical_{s}": s for s in SHARES},
}
HISTORY_NAMES = (*_HISTORY, "historical_term_count")
HISTORY = METRICS + f""", annual AS (
  SELECT subject, number, title, year, count(DISTINCT term) AS terms, {", ".join(f"avg({c}) AS {c}" for c in _HISTORY.values())}
  FROM d GROUP BY subject, number, title, year
), prior AS (
  SELECT d.year, d.term, d.subject, d.number, d.title, sum(a.terms)::DOUBLE AS historical_term_count,
    {", ".join(f"avg(a.{c}) AS {h}" for h, c in _HISTORY.items())}
  FROM d LEFT JOIN annual a ON a.subject = d.subject AND a.number = d.number AND a.title = d.title AND a.year < d.year
  GROUP BY d.year, d.term, d.subject, d.number, d.title
), level AS (
  SELECT d.*, prior.* EXCLUDE (year, term, subject, number, title),
    CASE WHEN d.year IN (1996, 1997) THEN 'train' ELSE 'holdout' END AS split,
    least(900.0, floor(d.number::DOUBLE / 100) * 100) AS course_level, d.year - 1996 AS year_offset,
    d.year || '|' || d.term || '|' || d.subject || '|' || d.number || '|' || d.title AS row_id
  FROM d JOIN prior USING (year, term, subject, number, title)
), cut AS (
  SELECT quantile_cont(w_proxy, 0.75) AS threshold, min(w_proxy) AS lowest FROM level WHERE split = 'train'
), f AS (
  SELECT level.*, threshold, CASE WHEN threshold = lowest THEN '>' ELSE '>=' END AS operator,
    CASE WHEN w_proxy IS NULL THEN NULL WHEN threshold = lowest THEN (w_proxy > threshold)::BIGINT
         ELSE (w_proxy >= threshold)::BIGINT END AS high_w_risk
  FROM level, cut
)"""

STABLE = RAW + f""", six AS (
  SELECT *, regexp_matches(title, '{SPECIAL_TOPIC_PATTERN}', 'i') AS is_special FROM raw WHERE year BETWEEN 1995 AND 2000
), ordinary AS (SELECT * FROM six WHERE NOT is_special
), best AS (
  SELECT year, term, subject, number, title FROM (
    SELECT *, row_number() OVER (PARTITION BY year, term, subject, number ORDER BY n DESC, title) AS place FROM (
      SELECT year, term, subject, number, trim(title) AS title, count(*) AS n FROM ordinary GROUP BY ALL))
  WHERE place = 1
), stable_sums AS (
  SELECT year, term, subject, number, {_each("sum({b}) AS {b}")}, sum(w) AS w, sum(students) AS students
  FROM ordinary GROUP BY year, term, subject, number
), stable_totals AS (
  SELECT stable_sums.*, best.title, {_TOTAL} AS grade_total, students + w AS demand_proxy
  FROM stable_sums JOIN best USING (year, term, subject, number)
), st AS (
  SELECT *, 'base' AS course_variant, CASE WHEN grade_total > 0 THEN ({_POINTS}) / grade_total END AS grade_point_mean,
    CASE WHEN demand_proxy > 0 THEN w / demand_proxy END AS w_proxy, (coalesce(w, 0) > 0)::BIGINT AS w_flag,
    least(900.0, floor(number::DOUBLE / 100) * 100) AS course_level
  FROM stable_totals
)"""

_FIELDS = ("w_flag", "w_mark_share", "demand_proxy", "students", "grade_point_mean")


def _lag_join(k: int) -> str:
    return f"""
  LEFT JOIN same s{k} ON s{k}.subject = st.subject AND s{k}.number = st.number AND s{k}.term = st.term AND s{k}.year = st.year - {k}
  LEFT JOIN yearly y{k} ON y{k}.subject = st.subject AND y{k}.number = st.number AND y{k}.year = st.year - {k}"""


_LAG_COLUMNS = ", ".join(
    f"CASE WHEN mode = 'any_term' THEN y{k}.{f} ELSE s{k}.{f} END AS lag{k}_{f}" for k in (1, 2, 3) for f in _FIELDS
)
LAGS = STABLE + f""", modes AS (
  SELECT subject, number, CASE WHEN count(DISTINCT term) = 1 THEN 'same_term' ELSE 'any_term' END AS mode FROM st GROUP BY ALL
), same AS (SELECT *, w_proxy AS w_mark_share FROM st
), year_sums AS (
  SELECT subject, number, year, max(w_flag) AS w_flag, coalesce(sum(w), 0) AS w, coalesce(sum(students), 0) AS students,
    coalesce(sum(demand_proxy), 0) AS demand_proxy, coalesce(sum(grade_total), 0) AS grade_total,
    coalesce(sum(grade_point_mean * grade_total), 0) AS points
  FROM st GROUP BY subject, number, year
), yearly AS (
  SELECT *, CASE WHEN demand_proxy > 0 THEN w / demand_proxy END AS w_mark_share,
    CASE WHEN grade_total > 0 THEN points / grade_total END AS grade_point_mean FROM year_sums
), lag_rows AS (
  SELECT st.*, mode AS term_match_mode, {_LAG_COLUMNS}
  FROM st JOIN modes ON modes.subject = st.subject AND modes.number = st.number {_lag_join(1)} {_lag_join(2)} {_lag_join(3)}
), lagged AS (
  SELECT *, (lag1_w_flag IS NOT NULL)::BIGINT + (lag2_w_flag IS NOT NULL)::BIGINT + (lag3_w_flag IS NOT NULL)::BIGINT AS history_year_count,
    CASE WHEN lag1_demand_proxy >= 0 THEN ln(1 + lag1_demand_proxy) END AS lag1_log_demand_proxy,
    CASE WHEN year = 2000 THEN 'holdout' WHEN year IN (1998, 1999) THEN 'train' ELSE 'lag_initialization' END AS split
  FROM lag_rows
), targets AS (SELECT * FROM lagged WHERE year IN (1998, 1999, 2000) AND history_year_count = 3
)"""

BASELINES = LAGS + """, rate AS (SELECT avg(w_flag) AS p FROM targets WHERE split = 'train'
), guesses AS (
  SELECT targets.*, 'constant_baseline' AS model, p AS predicted_probability FROM targets, rate
  UNION ALL SELECT targets.*, 'persistence_baseline', coalesce(lag1_w_flag::DOUBLE, p) FROM targets, rate
), predictions AS (
  SELECT *, w_flag AS actual_w_flag, (predicted_probability >= 0.5)::BIGINT AS predicted_w_flag FROM guesses
)"""


def _score_metrics(rows: str, groups: str, tie: str, withheld: str) -> str:
    """Metrics per group from ``rows`` (y, p, guess, tie columns), window style."""
    on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in groups.split(","))
    return f""", scored AS (
  SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY p DESC, {tie}) AS place,
    count(*) OVER (PARTITION BY {groups}) AS total FROM {rows}
), base AS (
  SELECT {groups}, count(*) AS rows, sum(y) AS pos, count(*) - sum(y) AS neg, avg((p - y) * (p - y)) AS brier,
    count(*) FILTER (WHERE y = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE y = 0 AND guess = 1) AS fp,
    count(*) FILTER (WHERE y = 1 AND guess = 0) AS fn, count(*) FILTER (WHERE y = 0 AND guess = 0) AS tn,
    greatest(1, ceil(count(*) * 0.2::DOUBLE))::BIGINT AS k,
    sum(y) FILTER (WHERE place <= greatest(1, ceil(total * 0.2::DOUBLE))) AS top
  FROM scored GROUP BY {groups}
), by_score AS (SELECT {groups}, p, count(*) AS n, sum(y) AS s FROM {rows} GROUP BY {groups}, p
), curves AS (
  SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(n) OVER (PARTITION BY {groups}) AS tn_all,
    sum(s) OVER (PARTITION BY {groups}) AS ts FROM by_score
  WINDOW w AS (PARTITION BY {groups} ORDER BY p DESC)
), areas AS (
  SELECT {groups}, sum(s * cs / cn) AS ap, sum(s * (((tn_all - ts) - (cn - cs)) + (n - s) / 2)) AS auc
  FROM curves GROUP BY {groups}
), metrics AS (
  SELECT {", ".join("a." + g.strip() for g in groups.split(","))}, rows, pos::BIGINT AS positive_count, neg::BIGINT AS negative_count,
    CASE WHEN pos > 0 AND neg > 0 THEN 'ok' ELSE 'one_class' END AS status,
    CASE WHEN pos > 0 AND neg > 0 THEN {_r("ap / pos", "average_precision_ap").replace(" AS average_precision_ap", "")} END AS average_precision_ap,
    CASE WHEN pos > 0 AND neg > 0 THEN {_r("auc / (pos * neg)", "x").replace(" AS x", "")} END AS roc_auc,
    {_r("brier", "brier_score")}, {_r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END", "precision")},
    {_r("CASE WHEN pos > 0 THEN tp / pos ELSE 0.0::DOUBLE END", "recall")},
    {_r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END", "f1")},
    {_r("CASE WHEN pos > 0 AND neg > 0 THEN (tp / pos + tn / neg) / 2 END", "balanced_accuracy")},
    {", ".join(f"CASE WHEN pos > 0 AND neg > 0 THEN {c} END AS {c}" for c in ("tn", "fp", "fn", "tp"))},
    CASE WHEN pos > 0 AND neg > 0 AND NOT ({withheld}) THEN round(top / pos, {DIGITS}) END AS recall_at_k,
    CASE WHEN pos > 0 AND neg > 0 AND NOT ({withheld}) THEN top::BIGINT END AS positive_in_top_k,
    k AS recall_at_k_rows, CASE WHEN {withheld} THEN 'not_applicable_ties' ELSE 'computed' END AS recall_at_k_status
  FROM base a JOIN areas b ON {on}
)"""


BASELINE_METRICS = BASELINES + """, score_rows AS (
  SELECT model, split, unnest(['all', term]) AS scope, w_flag AS y, predicted_probability AS p, predicted_w_flag AS guess,
    year, term, subject, number FROM predictions
)""" + _score_metrics("score_rows", "model, split, scope", "year, term, subject, number", "true")

CONTINUITY = STABLE + """, periods AS (SELECT DISTINCT subject, number, year, term FROM st
), islands AS (
  SELECT subject, number, term, max(n) AS run FROM (
    SELECT subject, number, term, year - place AS island, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY subject, number, term ORDER BY year) AS place FROM periods) GROUP BY ALL)
  GROUP BY subject, number, term
), runs AS (
  SELECT subject, number, coalesce(max(run) FILTER (WHERE term = 'spring'), 0) AS max_consecutive_spring_years,
    coalesce(max(run) FILTER (WHERE term = 'fall'), 0) AS max_consecutive_fall_years FROM islands GROUP BY ALL
), facts AS (
  SELECT subject, number,
    string_agg(DISTINCT year::VARCHAR, ', ' ORDER BY year::VARCHAR) AS observed_years,
    CASE WHEN count(DISTINCT term) = 2 THEN 'spring, fall' ELSE min(term) END AS observed_terms,
    string_agg(year || ' ' || term, ' | ' ORDER BY year, term) AS observed_periods,
    count(DISTINCT year) AS observed_year_count, count(*) AS observed_period_count,
    count(*) FILTER (WHERE term = 'spring') AS spring_count, count(*) FILTER (WHERE term = 'fall') AS fall_count,
    coalesce(string_agg(year::VARCHAR, ', ' ORDER BY year) FILTER (WHERE term = 'spring'), '') AS spring_years,
    coalesce(string_agg(year::VARCHAR, ', ' ORDER BY year) FILTER (WHERE term = 'fall'), '') AS fall_years,
    CASE WHEN count(DISTINCT term) = 1 THEN 'same_term' ELSE 'any_term' END AS term_match_mode,
    count(DISTINCT year) FILTER (WHERE year BETWEEN 1997 AND 1999) AS primary_observed_year_count,
    count(*) FILTER (WHERE year BETWEEN 1997 AND 1999) AS primary_observed_period_count,
    coalesce(string_agg(DISTINCT year::VARCHAR, ', ' ORDER BY year::VARCHAR) FILTER (WHERE year BETWEEN 1997 AND 1999), '') AS primary_years,
    coalesce(string_agg(term, ', ' ORDER BY term) FILTER (WHERE year = 2000), '') AS bridge_terms,
    """ + ", ".join(
    f"CASE WHEN count(DISTINCT term) = 1 THEN count(DISTINCT year) FILTER (WHERE year BETWEEN {t - 3} AND {t - 1}) = 3 "
    f"ELSE count(DISTINCT year) FILTER (WHERE year BETWEEN {t - 3} AND {t - 1}) = 3 END AS same_term_history_{t}"
    for t in (1998, 1999, 2000)
) + """
  FROM periods GROUP BY subject, number
), classed AS (
  SELECT *, 'base' AS course_variant, 12 AS expected_period_count, observed_period_count / 12 AS period_coverage,
    CASE WHEN observed_period_count = 12 THEN 'continuous_both_terms'
         WHEN fall_count = 0 AND spring_count = 6 THEN 'seasonal_spring'
         WHEN spring_count = 0 AND fall_count = 6 THEN 'seasonal_fall' ELSE 'intermittent' END AS continuity_class,
    same_term_history_1998 OR same_term_history_1999 AS training_eligible, same_term_history_2000 AS backtest_eligible
  FROM facts JOIN runs USING (subject, number)
), continuity AS (
  SELECT *, continuity_class <> 'continuous_both_terms' AS is_seasonal_or_intermittent,
    CASE WHEN backtest_eligible THEN '' WHEN observed_year_count < 3 THEN 'fewer_than_minimum_observed_years'
         WHEN term_match_mode = 'same_term' THEN 'seasonal_series_lacks_three_same_term_history'
         ELSE 'ordinary_series_lacks_three_prior_year_history' END AS excluded_reason
  FROM classed
)"""

CHOSEN = METRICS + f""", chosen AS (SELECT * FROM d WHERE year IN (1997, 1998) AND subject IN {SUBJECTS}
)"""

_DAY_LIST = "['MON', 'TUE', 'WED', 'THU', 'FRI', 'SAT', 'SUN']"
_HHMM = "lpad((({0}) // 60)::VARCHAR, 2, '0') || ':' || lpad((({0}) % 60)::VARCHAR, 2, '0')"
MEETINGS = f"""
clock AS (SELECT *, hour(ts) * 60 + minute(ts) AS s, hour(ts) * 60 + minute(ts) + 20 + event_id % 60 AS e,
    (day(ts) % 7 + 1)::INT AS dno FROM events
), meetings AS (
  SELECT 'w' || weekofyear(ts) AS term, 'U' AS subject, (user_id % 7)::VARCHAR AS number, user_id::VARCHAR AS crn,
    event_id AS meeting_index, event_type AS meeting_type,
    CASE WHEN event_id % 4 = 0 THEN [{_DAY_LIST}[dno], {_DAY_LIST}[dno % 7 + 1]] ELSE [{_DAY_LIST}[dno]] END AS weekdays,
    {_HHMM.format("s")} AS start_time, CASE WHEN e < 1440 THEN {_HHMM.format("e")} END AS end_time,
    CASE WHEN event_type = 'view' THEN '' ELSE 'Hall' END AS building, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'R1' END AS room,
    CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS start_date, '' AS end_date,
    event_type = 'error' AS is_arranged, event_type = 'signup' AS is_tba,
    'w' || weekofyear(ts) || ':U ' || user_id % 7 || ':' || user_id AS section_id, s, e
  FROM clock
), sections AS (
  SELECT 'w' || week AS term, 'U' AS subject, (user_id % 7)::VARCHAR AS number, user_id::VARCHAR AS crn,
    CASE WHEN first_id % 5 = 0 THEN '' ELSE 'S' || user_id END AS section_number, '1' AS part_of_term,
    strftime(first_ts, '%Y-%m-%d') AS start_date, CASE WHEN first_id % 13 = 0 THEN '' ELSE strftime(last_ts, '%Y-%m-%d') END AS end_date,
    CASE WHEN first_value >= 20 THEN floor(first_value) END AS credit_min, CASE WHEN first_value >= 10 THEN floor(first_value) + 1 END AS credit_max,
    'w' || week || ':U ' || user_id % 7 || ':' || user_id AS section_id
  FROM (SELECT weekofyear(ts) AS week, user_id, min(ts) AS first_ts, max(ts) AS last_ts, min(event_id) AS first_id,
          arg_min(value, event_id) AS first_value FROM events GROUP BY 1, 2)
), gaps AS (
  SELECT section_id, meeting_index, 1 AS part, unnest([
      CASE WHEN end_time IS NULL THEN 'meeting.' || meeting_index || '.end_time' END,
      CASE WHEN room = '' THEN 'meeting.' || meeting_index || '.room' END]) AS field, unnest([1, 2]) AS pos
  FROM meetings WHERE NOT is_arranged AND NOT is_tba
  UNION ALL SELECT section_id, -1, 0, unnest([CASE WHEN section_number = '' THEN 'section.section_number' END,
      CASE WHEN end_date = '' THEN 'section.end_date' END,
      CASE WHEN credit_min IS NULL AND credit_max IS NULL THEN 'section.credit' END]), unnest([1, 2, 3]) FROM sections
)"""

EDGES = MEETINGS + """, slots AS (
  SELECT m.section_id, s.term, s.crn, s.subject, s.number, s.section_number, m.meeting_type, m.meeting_index, m.start_time, m.end_time, m.s, m.e,
    CASE WHEN m.start_date <> '' THEN m.start_date ELSE s.start_date END AS ds,
    CASE WHEN m.end_date <> '' THEN m.end_date ELSE s.end_date END AS de, unnest(m.weekdays) AS day
  FROM meetings m JOIN sections s ON m.section_id = s.section_id
  WHERE NOT is_arranged AND NOT is_tba AND m.end_time IS NOT NULL
), pairs AS (
  SELECT a.term, a.day, a.section_id AS section_id_a, b.section_id AS section_id_b, a.crn AS crn_a, b.crn AS crn_b,
    a.subject AS subject_a, a.number AS number_a, a.section_number AS section_number_a, b.subject AS subject_b,
    b.number AS number_b, b.section_number AS section_number_b, greatest(a.ds, b.ds) AS date_start, least(a.de, b.de) AS date_end,
    a.start_time AS start_time_a, a.end_time AS end_time_a, b.start_time AS start_time_b, b.end_time AS end_time_b,
    (least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS overlap_minutes, a.meeting_type AS meeting_type_a, b.meeting_type AS meeting_type_b,
    a.meeting_index AS ia, b.meeting_index AS ib
  FROM slots a JOIN slots b ON a.term = b.term AND a.day = b.day AND a.section_id < b.section_id
  WHERE a.ds <> '' AND a.de <> '' AND b.ds <> '' AND b.de <> ''
    AND greatest(a.ds, b.ds) <= least(a.de, b.de) AND least(a.e, b.e) > greatest(a.s, b.s)
), edges AS (
  SELECT * EXCLUDE (ia, ib, place) FROM (SELECT *, row_number() OVER (PARTITION BY section_id_a, section_id_b, day, start_time_a,
    end_time_a, start_time_b, end_time_b, date_start, date_end ORDER BY ia, ib) AS place FROM pairs) WHERE place = 1
)"""

# What the generated course documents must parse to, told from the events.
DOCS = """
docs AS (
  SELECT *, 'w' || weekofyear(ts) AS term, 'EV' AS subject, user_id::VARCHAR AS number, (event_id // 3)::VARCHAR AS crn,
    'w' || weekofyear(ts) || ':EV ' || user_id AS course_id, 'w' || weekofyear(ts) || ':EV ' || user_id || ':' || event_id // 3 AS section_id,
    strftime(ts, '%Y-%m-%d') AS iso
  FROM events WHERE event_id % 97 <> 5
), last_section AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY event_id DESC) AS place FROM docs) WHERE place = 1
), last_course AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY event_id DESC) AS place FROM docs) WHERE place = 1
), people AS (
  SELECT term, subject, number, crn, section_id, event_id, 0 AS instructor_index, 'Ada' AS name, 'a@x.org' AS email, '' AS role FROM docs
  UNION ALL SELECT term, subject, number, crn, section_id, event_id, 1, event_type, '', '' FROM docs
), instructors AS (
  SELECT * EXCLUDE (place, event_id) FROM (SELECT *, row_number() OVER (PARTITION BY section_id, instructor_index, name ORDER BY event_id DESC) AS place FROM people)
  WHERE place = 1
), gened AS (
  SELECT DISTINCT term, subject, number, crn, section_id, CASE WHEN event_id % 4 = 0 THEN 'HUM' ELSE 'QR' END AS attribute_code FROM docs
), prereqs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY event_id DESC) AS place FROM docs WHERE value > 50) WHERE place = 1
)"""

_FETCHED = """
fetched AS (
  SELECT 'w' || weekofyear(ts) AS term, 'U' AS subject,
    CASE event_type WHEN 'view' THEN 'cache' WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'blocked' WHEN 'signup' THEN 'http_error' ELSE 'network_error' END AS status,
    CASE event_type WHEN 'click' THEN '200' WHEN 'purchase' THEN '403' WHEN 'signup' THEN '500' ELSE '' END AS http_status,
    CASE WHEN event_type IN ('view', 'click') THEN sha256(event_type || ' ' || day(ts)) ELSE '' END AS sha FROM events
)"""
EVIDENCE = MEETINGS + ", " + DOCS.strip() + ", " + _FETCHED.strip() + """, sizes AS (
  SELECT term, subject, sum(n) AS source_rows, sum(kept) AS kept_rows FROM (
    SELECT term, subject, count(*) AS n, count(*) AS kept FROM sections GROUP BY ALL
    UNION ALL SELECT term, subject, count(*), count(*) FROM meetings GROUP BY ALL
    UNION ALL SELECT term, subject, 6 * count(*) + count(*) FILTER (WHERE value > 50), 3 * count(DISTINCT section_id) FROM docs GROUP BY ALL
    UNION ALL SELECT term, subject, 0, count(*) FROM instructors GROUP BY ALL UNION ALL SELECT term, subject, 0, count(*) FROM gened GROUP BY ALL
    UNION ALL SELECT term, subject, 0, count(*) FROM prereqs GROUP BY ALL) GROUP BY ALL
), found AS (
  SELECT term, subject, min(CASE status WHEN 'ok' THEN 1 WHEN 'cache' THEN 2 WHEN 'blocked' THEN 3 WHEN 'http_error' THEN 4 ELSE 5 END) AS best,
    string_agg(DISTINCT nullif(http_status, ''), ';' ORDER BY nullif(http_status, '')) AS http_status,
    string_agg(DISTINCT nullif(sha, ''), ';' ORDER BY nullif(sha, '')) AS file_hashes FROM fetched GROUP BY ALL
), holes AS (
  SELECT term, subject, string_agg(DISTINCT field, ';' ORDER BY field) AS missing FROM gaps JOIN sections USING (section_id)
  WHERE field IS NOT NULL GROUP BY term, subject
  UNION ALL SELECT DISTINCT term, subject, 'section.part_of_term' FROM docs
), evidence AS (
  SELECT term, subject, coalesce(['ok', 'cache', 'blocked', 'http_error', 'network_error'][best], 'missing') AS acquisition_status,
    coalesce(http_status, '') AS http_status, coalesce(file_hashes, '') AS file_hashes, coalesce(source_rows, 0)::BIGINT AS source_rows,
    coalesce(source_rows, 0)::BIGINT AS normalized_rows, coalesce(kept_rows, 0)::BIGINT AS kept_rows, coalesce(missing, '') AS missing_critical_fields
  FROM sizes FULL JOIN found USING (term, subject) LEFT JOIN holes USING (term, subject)
), rated AS (
  SELECT *, acquisition_status IN ('ok', 'cache') AND source_rows > 0 AND missing_critical_fields = '' AS verified FROM evidence
)"""

RESPONSES = """
responses AS (
  SELECT page_id, url, 200 AS code, false AS cached, false AS challenge, true AS typed, html AS body, 'page' AS form FROM pages
  UNION ALL
  SELECT page_id, url || '#again', CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 202 WHEN 2 THEN 403 WHEN 3 THEN 500 ELSE 200 END,
    page_id % 8 = 7, page_id % 8 = 4, false,
    CASE page_id % 8 WHEN 5 THEN '' WHEN 6 THEN '<course id="' || page_id || '"/>' WHEN 7 THEN '<course><name>x</course>' ELSE html END, 'again'
  FROM pages
), judged AS (
  SELECT *, CASE WHEN code IS NULL THEN NULL WHEN code = 202 OR challenge THEN 'WAF challenge or 202 accepted; no XML returned'
    WHEN code >= 400 THEN 'HTTP ' || code WHEN body = '' THEN 'empty body'
    WHEN typed OR lower(regexp_replace(body, '^\\s+', '')) LIKE '<!doctype html%' OR lower(regexp_replace(body, '^\\s+', '')) LIKE '<html%' THEN 'HTML body instead of XML'
    WHEN body = '<course><name>x</course>' THEN 'invalid XML' ELSE '' END AS error FROM responses
)"""

KEY = "year, term, subject, number, title"
SKEY = "year, term, subject, number"


def _doubles(sql_columns) -> str:
    return ", ".join(f"{c}::DOUBLE AS {c}" for c in sql_columns)


_SCALE_FIELDS = (
    "course_level", "lag1_w_mark_share", "lag2_w_mark_share", "lag3_w_mark_share",
    "lag1_grade_point_mean", "lag2_grade_point_mean", "lag3_grade_point_mean", "lag1_log_demand_proxy",
)
_SCALE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM targets WHERE split = 'train'" for c in _SCALE_FIELDS
)
_MEASURES = (*BANDS, "w", "students")
_RAW_COLUMNS = ("year", "term", "year_term", "subject", "number", "title", "sched_type", *BANDS, "w", "students", "instructor")
_STABLE_COLUMNS = (
    "year", "term", "subject", "number", "course_variant", *BANDS, "w", "students", "title", "grade_total",
    "grade_point_mean", "demand_proxy", "w_proxy", "w_mark_share", "w_flag", "course_level",
)


def _inventory(name: str, source: str, columns) -> str:
    listed = ", ".join(columns)
    missing = " + ".join(f"({c} IS NULL)::BIGINT" for c in columns)
    return f"""SELECT '{name}' AS "table", sum(n)::BIGINT AS rows, {len(columns)} AS columns,
      coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_rows, sum(n * gaps)::BIGINT AS missing_cells
    FROM (SELECT {listed}, count(*) AS n, {missing} AS gaps FROM {source} GROUP BY {listed})"""


def _numeric_summary() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS non_null, count(*) - count({c}) AS missing, min({c}) AS min, "
        f"median({c}) AS median, {_r(f'avg({c})', 'mean')}, max({c}) AS max, 0::BIGINT AS non_numeric_in_scope FROM ordinary"
        for c in _MEASURES
    )


_TITLE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    w = lambda beginning, select: f"WITH {beginning.strip()} {select}"
    out = {}
    out["src_panel"] = w(RAW, """SELECT year, term, count(*) AS rows, sum(students) AS students, sum(w) AS w,
      count(*) - count(students) AS students_missing FROM scope GROUP BY year, term""")
    out["read_meetings"] = w(MEETINGS, """SELECT term, subject, number, crn, section_id, meeting_index, meeting_type, '' AS days_raw,
      array_to_string(weekdays, '|') AS weekdays, start_time, end_time, building, room, start_date, end_date, is_arranged, is_tba FROM meetings""")
    out["file_manifest"] = "SELECT url AS path, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages"
    out["source_coverage"] = w(RAW, """SELECT count(*) AS record_count, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years,
      string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM raw""")
    out["fetch_status"] = w(RESPONSES, """SELECT page_id, url, CASE WHEN cached THEN 'cache' WHEN code IS NULL THEN 'network_error' WHEN code = 200 THEN 'ok'
      WHEN code = 403 THEN 'blocked' ELSE 'http_error' END AS status, coalesce(code::VARCHAR, '') AS http_status,
      CASE WHEN code = 200 THEN sha256(body) ELSE '' END AS sha256,
      CASE WHEN code = 200 THEN octet_length(encode(body))::BIGINT ELSE 0 END AS bytes,
      CASE WHEN cached OR code IS NULL OR code = 200 THEN ''
        ELSE 'HTTP ' || code || '; WAF/rate-limit/block evidence preserved; no bypass attempted' END AS fetch_error,
      (SELECT max(j.error) FROM judged j WHERE j.url = judged.url) AS error FROM judged""")
    out["fetch_offline"] = w(RESPONSES, """SELECT page_id, url, CASE WHEN cached THEN 'cache' ELSE 'blocked' END AS status,
      CASE WHEN cached THEN coalesce(code::VARCHAR, 'cache') ELSE '' END AS http_status, CASE WHEN cached THEN sha256(body) ELSE '' END AS sha256,
      CASE WHEN cached THEN octet_length(encode(body))::BIGINT ELSE 0 END AS bytes,
      CASE WHEN cached THEN '' ELSE 'live acquisition disabled; cache miss' END AS error FROM responses""")
    out["fetch_manifest"] = w(RESPONSES, """, asked AS (SELECT CASE WHEN code = 200 THEN 'schedule' ELSE 'grades' END AS source, code, error FROM judged)
      SELECT source, count(*) AS requested, count(*) FILTER (WHERE code IS NOT NULL AND error = '') AS files,
      count(*) FILTER (WHERE code IS NOT NULL AND error <> '') AS failures,
      count(*) FILTER (WHERE code IS NOT NULL AND error <> '') = 0 AS complete FROM asked GROUP BY source""")
    out["xml_refs"] = """SELECT 'EV ' || user_id AS id, '/c/' || event_id AS href FROM events
      UNION ALL SELECT 'EV 9', '/d/' || event_id FROM events WHERE event_id % 2 = 0"""
    out["xml_courses"] = w(DOCS, """SELECT course_id, term, subject, number, 'Logic & ' || event_type AS title, '' AS description,
      3.0::DOUBLE AS credit_min, 3.0::DOUBLE AS credit_max, '3 hours' AS credit_text FROM last_course""")
    out["xml_sections"] = w(DOCS, """SELECT section_id, term, subject, number, crn, course_id, 'S' || event_id AS section_number, '' AS part_of_term,
      iso AS start_date, strftime(ts, '%Y-%m-%d') AS end_date, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 3.0 END AS credit_min,
      CASE WHEN event_id % 3 = 0 THEN 4.0::DOUBLE ELSE 3.0 END AS credit_max,
      CASE WHEN event_id % 3 = 0 THEN '1 TO 4 hours' ELSE '3 hours' END AS credit_text FROM last_section""")
    out["xml_meetings"] = w(DOCS, """SELECT section_id, meeting_index, term, subject, number, crn, meeting_type,
      CASE event_id % 5 WHEN 0 THEN 'ARRANGED' WHEN 1 THEN 'TBA' WHEN 2 THEN 'MWF' ELSE 'TTh' END AS days_raw,
      CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'MON|WED|FRI' ELSE 'TUE|THU' END AS weekdays,
      CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%H:%M') END AS start_time, CASE WHEN event_id % 5 <> 0 THEN '23:45' END AS end_time,
      '' AS building, CASE WHEN event_id % 6 = 0 THEN 'TBD' ELSE 'R1' END AS room, iso AS start_date, iso AS end_date,
      event_id % 5 = 0 AS is_arranged, event_id % 5 = 1 OR event_id % 6 = 0 AS is_tba
      FROM (SELECT *, unnest([0, 1]) AS meeting_index, unnest(CASE WHEN event_id % 7 = 4 THEN ['', ''] ELSE ['Lecture', 'Lab'] END) AS meeting_type FROM last_section)""")
    out["xml_unmatched"] = w(DOCS, """SELECT term, 'catalog' AS parent_tag, 'note' AS tag, count(*) AS elements FROM docs WHERE event_id % 7 = 1 GROUP BY term
      UNION ALL SELECT term, 'section', 'capacity', count(*) FROM docs WHERE event_id % 7 = 2 GROUP BY term""")
    out["xml_instructors"] = w(DOCS, "SELECT * FROM instructors")
    out["xml_gened"] = w(DOCS, "SELECT *, attribute_code AS attribute_description FROM gened")
    out["xml_prereqs"] = w(DOCS, "SELECT course_id, term, subject, number, 'After ' || event_type AS prerequisite_text FROM prereqs")
    out["xml_unreadable"] = "SELECT 'w' || weekofyear(ts) AS term, event_id AS doc_order FROM events WHERE event_id % 97 = 5"

    out["panel_filter"] = w(RAW, "SELECT year, term, subject, count(*) AS rows, sum(students) AS students, sum(w) AS w FROM scope GROUP BY ALL")
    out["coerce_numeric"] = """SELECT l_linenumber, form, count(*) AS rows, count(v) AS parsed, sum(v) AS total FROM (
      SELECT l_linenumber, 'given' AS form, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS v FROM lineitem
      UNION ALL SELECT l_linenumber, 'made', CASE l_linenumber % 4 WHEN 0 THEN -150.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE END FROM lineitem)
      GROUP BY l_linenumber, form"""
    out["course_level"] = """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 3) THEN least(900, p_partkey // 100 * 100)::DOUBLE END AS history_level,
      CASE WHEN p_partkey % 4 IN (0, 3) THEN least(900, p_partkey // 100 * 100)::DOUBLE WHEN p_partkey % 4 = 1 THEN 0.0::DOUBLE END AS trajectory_level FROM part"""
    out["demand_proxy"] = w(RAW, "SELECT subject, count(*) AS rows, count(students + w) AS valid_rows, sum(students + w) AS demand FROM scope GROUP BY subject")
    out["w_share"] = w(RAW, f"""SELECT subject, count(s) AS valid_rows, {_r("avg(s)", "share_mean")} FROM (
      SELECT subject, CASE WHEN students + w > 0 THEN w / (students + w) END AS s FROM scope) GROUP BY subject""")
    out["band_shares"] = w(METRICS, f"SELECT {KEY}, {_rs(*SHARES)} FROM m")
    out["grade_point_mean"] = w(METRICS, f"SELECT {KEY}, grade_total, {_r('grade_point_mean')} FROM m")
    out["time_split"] = w(METRICS, "SELECT CASE WHEN year = 1998 THEN 'holdout' ELSE 'train' END AS split, year, count(*) AS rows FROM m GROUP BY ALL")
    out["special_filter"] = w(STABLE, "SELECT year, term, is_special, count(*) AS rows FROM six GROUP BY ALL")
    out["title_norm"] = f"SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, {_TITLE.format('text')} AS t FROM documents)"
    out["parse_fields"] = """WITH e AS (SELECT *, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN
        CASE WHEN hour(ts) = 12 THEN 12 WHEN hour(ts) < 12 THEN hour(ts) + 12 ELSE NULL END ELSE hour(ts) END AS h,
        CASE WHEN event_id % 4 = 2 THEN 0 ELSE minute(ts) END AS mi FROM events)
      SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'TUE|THU' WHEN 1 THEN 'MON|WED|FRI' WHEN 3 THEN 'MON|TUE|WED|THU|FRI|SAT|SUN' WHEN 4 THEN 'FRI|MON' ELSE '' END AS weekdays,
        CASE WHEN h IS NOT NULL THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(mi::VARCHAR, 2, '0') END AS clock,
        (h * 60 + mi)::BIGINT AS minutes,
        CASE event_id % 3 WHEN 0 THEN least(floor(value), 2.5) WHEN 1 THEN 3.0::DOUBLE END AS credit_min,
        CASE event_id % 3 WHEN 0 THEN greatest(floor(value), 2.5) WHEN 1 THEN 3.0::DOUBLE END AS credit_max,
        CASE event_id % 3 WHEN 0 THEN floor(value)::BIGINT || ' TO 2.5 hours' WHEN 1 THEN '3 hours' ELSE 'none' END AS credit_text,
        CASE WHEN event_id % 3 = 2 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS iso_date,
        CASE event_id % 3 WHEN 0 THEN 'CS' WHEN 1 THEN 'MATH' ELSE '' END AS subject,
        CASE event_id % 3 WHEN 0 THEN user_id || 'A' WHEN 1 THEN user_id::VARCHAR ELSE '' END AS number FROM e"""

    out["course_term_metrics"] = w(METRICS, f"""SELECT {KEY}, {", ".join(BANDS)}, w, students, {_r("w_mark_share", "w_proxy")}, {_rs("w_mark_share")},
      grade_total, {_rs("grade_point_mean", *SHARES)} FROM m""")
    out["demand_metrics"] = w(DEMAND, f"""SELECT {KEY}, students, w, {_r("w_proxy")}, demand_proxy, is_high_demand, demand_rank,
      w_proxy_rankable, w_proxy_rank FROM ranked""")
    out["demand_quality"] = w(DEMAND, """SELECT count(*) - count(demand_proxy) AS rows_with_missing_or_negative_counts,
      count(demand_proxy) AS rows_with_valid_demand_proxy, count(w_proxy) AS rows_with_valid_w_proxy,
      count(*) FILTER (WHERE w_proxy_rankable) AS rows_rankable_for_w_proxy FROM ranked""")
    doubles = ("students_total", "w_total", "demand_proxy_total", "demand_proxy_mean", "demand_proxy_median", "demand_proxy_max",
               "w_proxy_weighted", "w_proxy_course_term_mean", "w_proxy_course_term_max", "high_demand_share")
    out["course_summary"] = w(SUMMARY, f"""SELECT subject, number, title, course_term_count, year_count, term_count, years_observed, first_year, last_year,
      {_rs(*doubles)}, demand_valid_term_count, high_demand_term_count, high_demand_year_count, demand_total_rank, demand_mean_rank,
      w_proxy_rankable, w_proxy_weighted_rank FROM summary""")
    out["coverage"] = w(METRICS, "SELECT year, term, count(*) AS rows FROM d GROUP BY ALL")
    top = f"SELECT {KEY}, students, w, demand_proxy, {_r('w_proxy')} FROM"
    by_demand = f"ORDER BY demand_proxy DESC NULLS LAST, {KEY} LIMIT 10"
    by_share = "ORDER BY w_proxy DESC NULLS LAST, demand_proxy, subject, number, year, term, title LIMIT 10"
    by_course = "ORDER BY demand_proxy_total DESC NULLS LAST, demand_proxy_mean DESC NULLS LAST, subject, number, title LIMIT 10"
    out["top_demand"] = w(METRICS, f"{top} (SELECT * FROM d {by_demand})")
    out["top_share"] = w(DEMAND, f"{top} (SELECT * FROM ranked WHERE w_proxy_rankable {by_share})")
    out["top_courses"] = w(SUMMARY, f"""SELECT subject, number, title, course_term_count, year_count, demand_proxy_total, {_rs("demand_proxy_mean", "w_proxy_weighted")},
      high_demand_year_count FROM (SELECT * FROM summary {by_course})""")

    def named(section: str, source: str, **values: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, 0 AS position, '{k}' AS key, ({v})::DOUBLE AS value FROM {source}" for k, v in values.items())

    def listed(section: str, source: str, order: str, key: str, value: str) -> str:
        return f"""SELECT '{section}', row_number() OVER ({order}), {key}, {value} FROM (SELECT * FROM {source} {order} LIMIT 10)"""

    term_key = "year || '|' || term || '|' || subject || '|' || number || '|' || title"
    report = [
        named("row_counts", "ranked", course_term_rows="count(*)", valid_demand_rows="count(demand_proxy)", valid_w_proxy_rows="count(w_proxy)"),
        named("row_counts", "summary", course_rows="count(*)", subject_rows="count(DISTINCT subject)"),
        named("quality", "ranked", rows_with_missing_or_negative_counts="count(*) - count(demand_proxy)",
              rows_with_valid_demand_proxy="count(demand_proxy)", rows_with_valid_w_proxy="count(w_proxy)",
              rows_rankable_for_w_proxy="count(*) FILTER (WHERE w_proxy_rankable)"),
        named("ranking_parameters", "threshold", high_demand_quantile="0.75", high_demand_threshold="t", min_demand_for_w_ranking="20"),
        "SELECT 'coverage_by_year_term', 0, year || '|' || term, count(*)::DOUBLE FROM ranked GROUP BY year, term",
        listed("top_course_terms_by_demand", "ranked", by_demand.replace(" LIMIT 10", ""), term_key, "demand_proxy"),
        listed("top_course_terms_by_w_proxy", "(SELECT * FROM ranked WHERE w_proxy_rankable)", by_share.replace(" LIMIT 10", ""), term_key, f"round(w_proxy, {DIGITS})"),
        listed("top_courses_by_total_demand", "summary", by_course.replace(" LIMIT 10", ""), "subject || '|' || number || '|' || title", "demand_proxy_total"),
    ]
    out["demand_report"] = w(SUMMARY, " UNION ALL ".join(report))

    out["history_features"] = w(HISTORY, f"SELECT row_id, split, high_w_risk, course_level, year_offset, {_rs(*HISTORY_NAMES)} FROM f")
    any_history = f"coalesce({', '.join(HISTORY_NAMES)}) IS NOT NULL"
    measures = {"rows": "count(*)", "rows_with_any_history": f"count(*) FILTER (WHERE {any_history})",
                "rows_with_all_history_missing": f"count(*) FILTER (WHERE NOT {any_history})", **{h: f"count({h})" for h in HISTORY_NAMES}}
    out["history_coverage"] = w(HISTORY, " UNION ALL ".join(
        f"SELECT split, '{k}' AS measure, {v} AS value FROM f GROUP BY split" for k, v in measures.items()))
    out["risk_label"] = w(HISTORY, f"""SELECT split, count(high_w_risk) AS valid_rows, count(*) FILTER (WHERE high_w_risk = 1) AS positive_rows,
      count(*) FILTER (WHERE high_w_risk = 0) AS negative_rows,
      CASE WHEN count(DISTINCT high_w_risk) = 2 THEN 'two_class' ELSE 'one_class' END AS class_status,
      {_r("max(threshold)", "threshold")}, max(operator) AS operator FROM f GROUP BY split""")
    profile = ("course_level", "students", "grade_total", *SHARES, *[h for h in HISTORY_NAMES if "share_" not in h], "w_proxy")
    out["profile_means"] = w(HISTORY, f"""SELECT subject, number, title, {", ".join(_r(f"avg({c})", c) for c in profile)}
      FROM f WHERE split = 'train' GROUP BY subject, number, title""")
    out["window_select"] = w(RAW, """, ct AS (SELECT year, coalesce(sum(w), 0) AS w FROM raw GROUP BY year, term, subject, number, title
      ), per_year AS (SELECT year, count(*) AS n, count(*) FILTER (WHERE w > 0) AS p, count(*) FILTER (WHERE w = 0) AS q FROM ct GROUP BY year
      ), windows AS (SELECT unnest([1995, 1996, 1997, 1998, 1999]) AS ws
      ), evidence AS (SELECT ws, count(*) AS years_present, sum(n)::BIGINT AS valid_rows, coalesce(sum(p) FILTER (WHERE year < ws + 2), 0)::BIGINT AS tp,
        coalesce(sum(q) FILTER (WHERE year < ws + 2), 0)::BIGINT AS tq FROM windows JOIN per_year ON year BETWEEN ws AND ws + 2 GROUP BY ws
      ), marked AS (SELECT *, years_present = 3 AND valid_rows >= 200 AND tp >= 20 AND tq >= 20 AS sufficient FROM evidence)
      SELECT ws AS window_start, years_present, valid_rows, tp AS train_positive_rows, tq AS train_negative_rows, sufficient,
        sufficient AND ws = (SELECT min(ws) FROM marked WHERE sufficient) AS selected FROM marked""")

    quality = [
        "SELECT 'rows' AS section, 'raw_rows' AS field, count(*) AS value FROM raw",
        "SELECT 'rows', 'filtered_rows', count(*) FROM scope",
        "SELECT 'rows', 'course_term_rows', count(*) FROM m",
        """SELECT 'rows', 'duplicate_rows', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM raw
           GROUP BY year, term, subject, number, title, sched_type, instructor HAVING count(*) > 1)""",
        *[f"SELECT 'filtered_missing', '{c}', count(*) - count({c}) FROM scope" for c in _RAW_COLUMNS],
        *[f"SELECT 'raw_non_numeric_in_scope', '{c}', 0" for c in _MEASURES],
    ]
    out["quality_report"] = w(METRICS, " UNION ALL ".join(quality))
    gap = " + ".join(f"abs((SELECT coalesce(sum({c}), 0) FROM scope) - (SELECT coalesce(sum({c}), 0) FROM m))" for c in _MEASURES)
    checks = {
        "filtered_has_required_columns": "true", "metrics_has_required_columns": "true",
        "filtered_year_in_window": f"(SELECT bool_and(year IN {YEARS}) FROM scope)", "metrics_year_in_window": f"(SELECT bool_and(year IN {YEARS}) FROM m)",
        "filtered_term_in_terms": "(SELECT bool_and(term IN ('spring', 'fall')) FROM scope)",
        "metrics_term_in_terms": "(SELECT bool_and(term IN ('spring', 'fall')) FROM m)",
        "metrics_w_proxy_in_range": "(SELECT bool_and(w_mark_share BETWEEN 0 AND 1) FROM m)",
        "metrics_group_keys_unique": f"(SELECT count(*) = count(DISTINCT ({KEY})) FROM m)",
        "split_by_window": "(SELECT count(*) FILTER (WHERE year < 1998) > 0 AND count(*) FILTER (WHERE year = 1998) > 0 FROM m)",
        "column_sums_match": f"{gap} <= 1e-6",
    }
    out["validate_tables"] = w(METRICS, " UNION ALL ".join(
        f"SELECT '{k}' AS \"check\", {v} AS passed, CASE WHEN {v} THEN '' ELSE 'failed' END AS detail" for k, v in checks.items()))
    failed = ", ".join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in checks.items())
    out["validation_summary"] = w(METRICS, f"""SELECT {" AND ".join(f"({v})" for v in checks.values())} AS passed, concat_ws(';', {failed}) AS errors,
      (SELECT count(*) FROM scope) AS filtered_rows, (SELECT count(*) FROM m) AS metrics_rows,
      (SELECT count(*) FROM m WHERE year < 1998) AS train_rows, (SELECT count(*) FROM m WHERE year = 1998) AS holdout_rows""")
    out["join_contract"] = w(METRICS, f"SELECT {KEY}, demand_proxy, sum(demand_proxy) OVER (PARTITION BY subject, number, title) AS course_demand FROM d")

    out["stable_terms"] = w(STABLE, f"""SELECT {SKEY}, course_variant, {", ".join(BANDS)}, w, students, title, grade_total, {_r("grade_point_mean")},
      demand_proxy, {_r("w_proxy")}, {_r("w_proxy", "w_mark_share")}, w_flag, course_level FROM st""")
    out["display_title"] = w(STABLE, "SELECT * FROM best")
    out["special_audit"] = w(STABLE, f"""SELECT {KEY}, count(*) AS source_rows, coalesce(sum(students), 0) AS students, coalesce(sum(w), 0) AS w
      FROM six WHERE is_special GROUP BY {KEY}""")
    keys = "(SELECT subject, number, bool_or(is_special) AS s, bool_or(NOT is_special) AS o FROM six GROUP BY ALL)"
    out["special_keys"] = w(STABLE, f"""SELECT count(*) FILTER (WHERE s) AS special_topic_course_keys_with_rows,
      count(*) FILTER (WHERE s AND NOT o) AS special_topic_only_course_keys_excluded,
      count(*) FILTER (WHERE s AND o) AS special_topic_overlap_course_keys_retained FROM {keys}""")
    out["special_key_split"] = w(STABLE, f"""SELECT count(*) FILTER (WHERE s) AS keys, count(*) FILTER (WHERE s AND o) AS overlap,
      count(*) FILTER (WHERE s AND NOT o) AS only FROM {keys}""")
    instructors = f"""SELECT {SKEY}, count(DISTINCT instructor) AS instructor_count,
      string_agg(DISTINCT instructor, ' | ' ORDER BY instructor) AS instructors_observed, count(*) AS source_rows FROM ordinary GROUP BY {SKEY}"""
    out["instructor_audit"] = w(STABLE, instructors)
    out["stable_with_instructors"] = w(STABLE, f"""SELECT {SKEY}, title, w, students, instructor_count, instructors_observed
      FROM st JOIN ({instructors}) USING ({SKEY})""")
    out["title_audit"] = w(STABLE, """SELECT subject, number, 'base' AS course_variant, count(DISTINCT title) AS title_count,
      string_agg(DISTINCT title, ' | ' ORDER BY title) AS titles_observed, count(DISTINCT title) > 1 AS title_changed FROM ordinary GROUP BY subject, number""")
    out["title_entries"] = w(STABLE, """SELECT subject, number, row_number() OVER (PARTITION BY subject, number ORDER BY title) - 1 AS ordinal, title
      FROM (SELECT DISTINCT subject, number, title FROM ordinary WHERE title IS NOT NULL)""")
    people = f"""SELECT {SKEY}, row_number() OVER (PARTITION BY {SKEY} ORDER BY instructor) - 1 AS ordinal, instructor
      FROM (SELECT DISTINCT {SKEY}, trim(instructor) AS instructor FROM ordinary WHERE trim(instructor) <> '')"""
    out["instructor_entries"] = w(STABLE, people)
    out["instructor_texts"] = w(STABLE, f"""SELECT {SKEY}, ordinal // 2 AS piece, string_agg(instructor, ' | ' ORDER BY ordinal) AS text
      FROM ({people}) GROUP BY ALL""")
    out["title_change_counts"] = w(STABLE, f""", norm AS (SELECT DISTINCT subject, number, year, term, {_TITLE.format("title")} AS t FROM ordinary
      ), per_key AS (SELECT subject, number, count(DISTINCT t) AS n FROM norm GROUP BY ALL
      ), sets AS (SELECT subject, number, year, string_agg(DISTINCT t, '~' ORDER BY t) AS s FROM norm GROUP BY ALL
      ), changed AS (SELECT subject, number FROM sets GROUP BY ALL HAVING count(DISTINCT s) > 1
      ), collided AS (SELECT subject, number, year, term FROM norm GROUP BY ALL HAVING count(DISTINCT t) > 1)
      SELECT 'course_keys' AS counter, count(*) AS value FROM per_key
      UNION ALL SELECT 'multi_title_base_count', count(*) FROM per_key WHERE n > 1
      UNION ALL SELECT 'cross_year_title_change_base_key_count', count(*) FROM changed
      UNION ALL SELECT 'collision_base_key_count', count(DISTINCT (subject, number)) FROM collided
      UNION ALL SELECT 'collision_course_term_count', count(*) FROM collided""")
    out["scope_counts"] = w(STABLE, """SELECT 'raw_input_rows' AS counter, count(*) AS value FROM raw UNION ALL SELECT 'raw_rows_in_scope', count(*) FROM six
      UNION ALL SELECT 'included_rows_in_scope', count(*) FROM ordinary UNION ALL SELECT 'special_topic_raw_rows_excluded', count(*) FROM six WHERE is_special
      UNION ALL SELECT 'course_term_rows', count(*) FROM st""")
    out["audit_counts"] = w(STABLE, """, source AS (SELECT year, term, sum(students) AS students, sum(w) AS w FROM ordinary GROUP BY ALL
      ), panel AS (SELECT year, term, sum(students) AS students, sum(w) AS w FROM st GROUP BY ALL
      ), gaps AS (SELECT coalesce(s.students, 0) - coalesce(p.students, 0) AS students, coalesce(s.w, 0) - coalesce(p.w, 0) AS w
        FROM source s FULL JOIN panel p USING (year, term))
      SELECT 'special_topic_audit_rows' AS counter, count(DISTINCT (year, term, subject, number, title)) AS value FROM six WHERE is_special
      UNION ALL SELECT 'special_topic_course_terms_with_rows', count(DISTINCT (year, term, subject, number)) FROM six WHERE is_special
      UNION ALL SELECT 'title_audit_rows', count(DISTINCT (subject, number)) FROM ordinary
      UNION ALL SELECT 'instructor_audit_rows', count(DISTINCT (year, term, subject, number)) FROM ordinary
      UNION ALL SELECT 'variant_count', count(DISTINCT (subject, number, course_variant)) FROM st
      UNION ALL SELECT 'reconciliation_all_zero', (count(*) FILTER (WHERE students <> 0 OR w <> 0) = 0)::BIGINT FROM gaps
      UNION ALL SELECT 'instructor_missing_source_rows_in_scope', count(*) FILTER (WHERE instructor IS NULL) FROM six""")
    lag_doubles = [f"lag{k}_{f}" for k in (1, 2, 3) for f in _FIELDS if f != "w_flag"]
    out["lag_panel"] = w(LAGS, f"""SELECT {SKEY}, term_match_mode, lag1_w_flag, lag2_w_flag, lag3_w_flag, {_rs(*lag_doubles)},
      {", ".join(_r(f"lag{k}_w_mark_share", f"lag{k}_w_proxy") for k in (1, 2, 3))}, history_year_count,
      history_year_count = 3 AS has_three_same_term_years, {_r("lag1_log_demand_proxy")}, split,
      year IN (1998, 1999, 2000) AND history_year_count = 3 AS eligible_target FROM lagged""")
    out["target_coverage"] = w(LAGS, """SELECT year, term, count(*) AS all_rows, count(*) FILTER (WHERE history_year_count = 3) AS eligible_rows
      FROM lagged WHERE year IN (1998, 1999, 2000) GROUP BY year, term""")
    annual = f"""SELECT year, term, count(*) AS course_term_rows, sum(w_flag)::BIGINT AS w_positive_rows, {_r("avg(w_proxy)", "w_proxy_mean")},
      coalesce(sum(w), 0) AS w_total FROM st GROUP BY year, term"""
    out["annual_w"] = w(STABLE, annual)
    named_periods = " OR ".join(f"(year = {y} AND term = '{t}')" for y, t in FLAGGED_PERIODS)
    out["period_flags"] = w(STABLE, f"SELECT year, term, year || ' ' || upper(term[1]) || term[2:] AS period, w_total FROM ({annual}) WHERE {named_periods}")
    continuity_columns = """subject, number, course_variant, observed_years, observed_terms, observed_periods, observed_year_count, observed_period_count,
      expected_period_count, spring_count, fall_count, spring_years, fall_years, max_consecutive_spring_years,
      max_consecutive_fall_years, continuity_class, term_match_mode, primary_observed_year_count, primary_observed_period_count, primary_years,
      bridge_terms, is_seasonal_or_intermittent, training_eligible, backtest_eligible, same_term_history_1998, same_term_history_1999,
      same_term_history_2000, excluded_reason"""
    out["course_continuity"] = w(CONTINUITY, f"SELECT {continuity_columns}, {_r('period_coverage')} FROM continuity")
    share = _r("count(*) / (SELECT count(*) FROM continuity)", "share")
    out["continuity_classes"] = w(CONTINUITY, f"""SELECT continuity_class, count(*) AS course_count, {share},
      median(observed_period_count)::DOUBLE AS median_observed_periods, CASE continuity_class WHEN 'continuous_both_terms' THEN 'Continuous both terms'
        WHEN 'seasonal_spring' THEN 'Spring-seasonal' WHEN 'seasonal_fall' THEN 'Fall-seasonal' ELSE 'Intermittent' END AS class_label
      FROM continuity GROUP BY continuity_class""")
    for name, column in (("continuity_periods", "observed_period_count"), ("continuity_primary_years", "primary_observed_year_count")):
        out[name] = w(CONTINUITY, f"SELECT {column}, count(*) AS course_count, {share} FROM continuity GROUP BY {column}")
    out["continuity_excluded"] = w(CONTINUITY, """SELECT subject, number, observed_period_count, observed_year_count, spring_count, fall_count, term_match_mode,
      observed_periods, continuity_class, backtest_eligible, excluded_reason FROM continuity
      WHERE NOT backtest_eligible AND continuity_class = 'intermittent' ORDER BY subject, number LIMIT 100""")

    stable_full = f"(SELECT *, w_proxy AS w_mark_share FROM st)"
    out["eda_inventory"] = w(STABLE, " UNION ALL ".join([
        _inventory("raw_input", "raw", _RAW_COLUMNS), _inventory("six_year_source", "six", _RAW_COLUMNS),
        _inventory("six_year_analysis", "ordinary", _RAW_COLUMNS), _inventory("course_term_metrics", stable_full, _STABLE_COLUMNS)]))
    out["reconcile"] = w(STABLE, """, a AS (SELECT year, term, count(*) AS source_rows, coalesce(sum(students), 0) AS source_students, coalesce(sum(w), 0) AS source_w FROM ordinary GROUP BY ALL
      ), b AS (SELECT year, term, count(*) AS metric_rows, coalesce(sum(students), 0) AS metric_students, coalesce(sum(w), 0) AS metric_w FROM st GROUP BY ALL)
      SELECT *, source_students - metric_students AS students_total_difference, source_w - metric_w AS w_total_difference FROM a FULL JOIN b USING (year, term)""")
    out["eda_subjects"] = w(STABLE, """SELECT subject, count(*) AS source_rows, count(DISTINCT number) AS course_numbers, coalesce(sum(students), 0) AS students,
      coalesce(sum(w), 0) AS w FROM ordinary GROUP BY subject""")
    out["eda_numeric"] = w(STABLE, _numeric_summary())
    out["eda_join_audit"] = w(STABLE, f"""SELECT 'six_year_spring_fall' AS from_table, 'course_term_metrics' AS to_table,
      'year + term + subject + number + title + sched_type + instructor' AS source_key_columns, 'year + term + subject + number' AS target_key_columns, 'many_to_one' AS relationship, (SELECT count(*) FROM ordinary) AS source_rows,
      (SELECT count(*) FROM st) AS target_rows, 0::BIGINT AS target_key_duplicates,
      (SELECT count(*) FROM (SELECT 1 FROM ordinary GROUP BY {SKEY} HAVING count(*) > 1)) AS source_groups_with_multiple_rows,
      (SELECT count(*) = count(DISTINCT ({SKEY})) FROM st) AS join_cardinality_valid""")

    out["feat_scale"] = w(LAGS, f""", long AS ({_SCALE}), middle AS (SELECT feature, median(v) AS med FROM long GROUP BY feature
      ), filled AS (SELECT feature, med, v, coalesce(v, med) AS x FROM long JOIN middle USING (feature))
      SELECT feature, {_r("max(med)", "median")}, {_r("avg(x)", "mean")}, {_r("stddev_pop(x)", "std")}, count(*) - count(v) AS missing, count(*) AS rows
      FROM filled GROUP BY feature""")
    out["backtest_baselines"] = w(BASELINES, f"""SELECT {SKEY}, model, split, term_match_mode, actual_w_flag, {_r("predicted_probability")}, predicted_w_flag,
      {_r("predicted_probability - actual_w_flag", "prediction_error")}, {_r("abs(predicted_probability - actual_w_flag)", "absolute_prediction_error")} FROM predictions""")
    out["baseline_metrics"] = w(BASELINE_METRICS, "SELECT * FROM metrics")
    labels = "CASE model WHEN 'constant_baseline' THEN 'Constant baseline' ELSE 'Persistence baseline' END AS model"
    out["metrics_long"] = w(BASELINE_METRICS, " UNION ALL ".join(
        f"SELECT {labels}, '{c}' AS metric, {c} AS value FROM metrics WHERE split = 'holdout' AND scope = 'all'"
        for c in ("average_precision_ap", "roc_auc", "f1", "recall")))
    out["model_metrics"] = w("""rows_in AS (SELECT doc_id, lang, quality AS y, round(n_chars / (SELECT max(n_chars) FROM documents), 2) AS p
        FROM documents JOIN labels USING (doc_id)), graded AS (SELECT *, (p >= 0.1)::BIGINT AS guess FROM rows_in)"""
        + _score_metrics("graded", "lang", "doc_id", "false"), "SELECT * FROM metrics")
    out["alias_resolve"] = w(BASELINES, f"""SELECT year, term, subject, number, '' AS title, actual_w_flag AS actual_w, {_r("predicted_probability")},
      predicted_w_flag AS predicted_w, model, split, subject || ' ' || number AS course FROM predictions""")

    numeric = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS sample_support FROM train" for c in _SCALE_FIELDS)
    levels = " UNION ALL ".join(f"SELECT '{c}' AS parent, {c}::VARCHAR AS level, count(*) AS n FROM train GROUP BY {c}" for c in ("subject", "term"))
    out["lr_certificate"] = w(LAGS, f""", train AS (SELECT * FROM targets WHERE split = 'train'), numeric AS ({numeric}), levels AS ({levels}
      ), ordered AS (SELECT *, row_number() OVER w AS place, first_value(level) OVER w AS top, first_value(n) OVER w AS top_n FROM levels
        WINDOW w AS (PARTITION BY parent ORDER BY n DESC, level)
      ), slots AS (SELECT '(intercept)' AS feature, NULL AS feature_type, NULL AS reference_category, NULL::BIGINT AS sample_support, NULL::BIGINT AS reference_support
        UNION ALL SELECT feature, 'numeric', '', sample_support, NULL FROM numeric
        UNION ALL SELECT parent || '_' || level, 'categorical', top, n, top_n FROM ordered WHERE place > 1)
      SELECT *, true AS stationary, (SELECT count(*) FROM train) AS rows, (SELECT count(*) FROM train WHERE w_flag = 1) AS positives FROM slots""")
    out["conflict_edges"] = w(EDGES, "SELECT * FROM edges")
    distinct = "(SELECT DISTINCT term, day, section_id, start_time, end_time, s, e, ds, de FROM slots WHERE ds <> '' AND de <> '' AND ds <= de)"
    out["conflict_counts"] = w(EDGES, f""", d AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM {distinct}
      ), met AS (SELECT x.term, x.day, x.s // 15 AS bucket, count(*) AS n FROM d x JOIN d y ON x.term = y.term AND x.day = y.day
        AND (y.s < x.s OR (y.s = x.s AND y.i < x.i)) AND y.e > x.s GROUP BY ALL
      ), cov AS (SELECT term, day, unnest(range(s // 15, (e - 1) // 15 + 1)) AS bucket, s FROM d
      ), places AS (SELECT term, day, bucket, count(*) FILTER (WHERE s // 15 = bucket) AS starts, count(*) AS covering FROM cov GROUP BY ALL)
      SELECT term, day, bucket, starts, covering, coalesce(n, 0) AS overlaps FROM places LEFT JOIN met USING (term, day, bucket) WHERE starts > 0""")
    out["missing_fields"] = w(MEETINGS, """SELECT section_id, s.term, s.subject, coalesce(missing, '') AS missing FROM sections s LEFT JOIN (
      SELECT section_id, string_agg(field, ';' ORDER BY part, meeting_index, pos) AS missing FROM gaps WHERE field IS NOT NULL GROUP BY section_id) USING (section_id)""")
    out["missing_entries"] = w(MEETINGS, """SELECT section_id, CASE WHEN part = 1 THEN meeting_index ELSE -1 END AS meeting_index, field, s.term, s.subject
      FROM gaps JOIN sections s USING (section_id) WHERE field IS NOT NULL""")
    out["schedule_quality"] = w(EVIDENCE, "SELECT * FROM rated")
    out["schedule_gate"] = w(EVIDENCE, """SELECT bool_or(verified) AS verified, CASE WHEN bool_or(verified) THEN ''
      ELSE 'No target term has verified acquisition and normalized data.' END AS reason FROM rated""")
    status = " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in STATES.items())
    out["event_chain"] = f"""WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id // 1000 + 1 END AS log_id,
        CASE WHEN event_id % 2 = 0 THEN event_id // 2 + 1 ELSE event_id % 1000 // 2 + 1 END AS sequence, event_type AS action, event_id, props FROM events
      ), hashed AS (SELECT *, sha256(sequence || '|' || action || '|' || coalesce(props, '')) AS true_hash FROM e
      ), linked AS (SELECT *, lag(true_hash) OVER (PARTITION BY log_id ORDER BY sequence) AS before FROM hashed
      ), stored AS (SELECT *, CASE WHEN event_id % 333 = 5 AND log_id % 2 = 1 THEN 'x' ELSE coalesce(before, repeat('0', 64)) END AS prev_hash,
        CASE WHEN event_id % 777 = 6 AND log_id % 3 = 0 THEN 'x' ELSE true_hash END AS event_hash, CASE action {status} END AS made FROM linked
      ), checked AS (SELECT *, CASE WHEN sequence = 1 THEN repeat('0', 64) ELSE lag(event_hash) OVER w END AS expected,
        coalesce(last_value(made IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'planned') AS state
        FROM stored WINDOW w AS (PARTITION BY log_id ORDER BY sequence)
      ), logs AS (SELECT log_id, count(*) AS events, min(sequence) = 1 AND max(sequence) = count(*) AS contiguous,
        count(*) FILTER (WHERE prev_hash <> expected) AS bad_links, count(*) FILTER (WHERE event_hash <> true_hash) AS bad_hashes,
        count(*) FILTER (WHERE (action = 'error' AND state NOT IN ('planned', 'accepted')) OR (action = 'signup' AND state <> 'rejected')) AS illegal,
        count(*) FILTER (WHERE action = 'purchase') AS attempts, coalesce(arg_max(made, sequence) FILTER (WHERE made IS NOT NULL), 'planned') AS status,
        arg_max(event_hash, sequence) AS head_hash FROM checked GROUP BY log_id
      ), compared AS (SELECT *, CASE WHEN log_id % 5 = 2 THEN 'planned' ELSE status END AS stored_status,
        log_id % 7 <> 3 AND (log_id % 5 <> 2 OR status = 'planned') AS agrees FROM logs)
      SELECT *, contiguous AND bad_links = 0 AND bad_hashes = 0 AND illegal = 0 AND agrees AS ok FROM compared"""

    out["dash_filter"] = w(CHOSEN, """SELECT subject, number, title, sum(demand_proxy) AS demand_proxy_total FROM d
      WHERE (subject, number, title) IN (SELECT (subject, number, title) FROM chosen) GROUP BY ALL""")
    out["dash_kpi"] = w(CHOSEN, """SELECT count(*) AS course_terms, count(DISTINCT (subject, number)) AS course_keys, coalesce(sum(students), 0) AS students,
      coalesce(sum(w), 0) AS w FROM chosen""")
    courses = f"""SELECT subject, number, min(title) AS title, coalesce(sum(demand_proxy), 0) AS demand_proxy_total, count(*) AS course_term_count,
      coalesce(sum(w), 0) AS w_total, {_r("CASE WHEN sum(demand_proxy) > 0 THEN sum(w) / sum(demand_proxy) END", "w_proxy_weighted")} FROM {{0}} GROUP BY subject, number"""
    out["dash_courses"] = w(CHOSEN, courses.format("chosen"))
    out["dash_labels"] = w(CHOSEN, """SELECT year, CASE term WHEN 'spring' THEN 'Spring' ELSE 'Fall' END AS term_label,
      subject || ' ' || number || ' · ' || title AS course, demand_proxy FROM chosen""")
    out["dash_trend"] = w(METRICS, f"""SELECT year, term, coalesce(sum(demand_proxy), 0) AS demand_proxy, {_r("avg(w_mark_share)", "w_mark_share")}, count(*) AS course_terms,
      year || ' ' || CASE term WHEN 'spring' THEN 'Spring' ELSE 'Fall' END AS year_term FROM d GROUP BY year, term""")
    out["dash_top_courses"] = w(METRICS, f"SELECT * FROM ({courses.format('d')}) ORDER BY demand_proxy_total DESC, subject, number LIMIT 10")
    out["dash_top"] = w(METRICS, f"""SELECT {KEY}, w, demand_proxy, {_r("w_mark_share")} FROM (SELECT * FROM d WHERE demand_proxy >= 20 AND w_mark_share IS NOT NULL
      ORDER BY w_mark_share DESC, {KEY} LIMIT 25)""")
    out["dash_sample"] = w(METRICS, f"""SELECT {KEY}, demand_proxy, {_r("w_mark_share")} FROM (SELECT * FROM d ORDER BY sha256(
      year || '|' || term || '|' || subject || '|' || number || '|' || title), {KEY} LIMIT 5000)""")
    return out

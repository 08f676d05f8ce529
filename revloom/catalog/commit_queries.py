"""Commit, time, contributor and persistence analyses."""

from pyspark.sql import functions as F

from revloom.catalog.registry import query
from revloom.operators import commits, contributors, persistence, stats

WORDS_SQL = """SELECT repo, hash, message, array_to_string(list_sort(list_distinct(regexp_extract_all(
  lower(message), '\\b(?:{words})\\b'))), ',') AS keywords FROM commits
WHERE regexp_matches(lower(message), '\\b(?:{words})\\b')"""
FIX = "fix|fixes|fixed|bug|repair|correct|patch|resolve"
FEATURE = ("feature|feat|add|adds|added|implement|implements|implemented|create|creates|created|"
           "introduce|introduces|introduced")


def _joined(df):
    return df.withColumn("keywords", F.array_join("keywords_matched", ","))


@query("P14_U2_bug_fix_commits", "repo hash message keywords", WORDS_SQL.format(words=FIX), "commits")
def p14(t):
    return _joined(commits.bug_fix_commits(t.commits))


@query("P15_feature_commits", "repo hash message keywords", WORDS_SQL.format(words=FEATURE),
       "commits")
def p15(t):
    return _joined(commits.feature_commits(t.commits))


PROSE = {"prose": """SELECT source AS repo, CAST(doc_id AS VARCHAR) AS hash, text AS message
  FROM documents"""}


@query("P14_keyword_search_in_prose", "repo hash keywords", """
SELECT repo, hash, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(message),
  '\\b(?:is|the|license|password)\\b'))), ',') AS keywords FROM prose
WHERE regexp_matches(lower(message), '\\b(?:is|the|license|password)\\b')""", extra=PROSE)
def p14_prose(t):
    prose = t.read("documents").select(F.col("source").alias("repo"),
                                       F.col("doc_id").cast("string").alias("hash"),
                                       F.col("text").alias("message"))
    return _joined(commits.keyword_commits(prose, ("is", "the", "license", "password")))


def _frequency_sql(by, step, end):
    return f"""
SELECT s.repo, {end} AS period, coalesce(n, 0) AS commit_count
FROM (SELECT repo, CAST(unnest(generate_series(min(b), max(b), INTERVAL {step})) AS DATE) AS b
      FROM bins GROUP BY repo) s
LEFT JOIN bins c ON c.repo = s.repo AND c.b = s.b"""


def _bins(by, table="ord"):
    return {"bins": f"""SELECT repo, CAST(date_trunc('{by}', date) AS DATE) AS b, count(*) AS n
      FROM {table} GROUP BY ALL"""}


for _by, _step, _end in (
        ("day", "1 DAY", "s.b"), ("week", "7 DAY", "s.b + 6"),
        ("month", "1 MONTH", "CAST(s.b + INTERVAL 1 MONTH AS DATE) - 1"),
        ("quarter", "3 MONTH", "CAST(s.b + INTERVAL 3 MONTH AS DATE) - 1"),
        ("year", "1 YEAR", "CAST(s.b + INTERVAL 1 YEAR AS DATE) - 1")):
    query(f"A5_commit_frequency_{_by}", "repo period commit_count:l",
          _frequency_sql(_by, _step, _end), "ord", extra=_bins(_by))(
        lambda t, by=_by: commits.commit_frequency(t.orders, by))


@query("A5_event_frequency_day", "repo period commit_count:l", _frequency_sql("day", "1 DAY", "s.b"),
       "ev", extra=_bins("day", "ev"))
def a5_events(t):
    return commits.commit_frequency(t.events, "day")


@query("A14_W1_F14_monthly_commits", "repo month commit_count:l moving_average:d trend", """
SELECT repo, strftime(b, '%Y-%m') AS month, n AS commit_count,
  CASE WHEN count(*) OVER w = 3 AND count(*) OVER (PARTITION BY repo) > 3 THEN avg(n) OVER w END
    AS moving_average,
  repeat('█', CAST(floor(n::DOUBLE / max(n) OVER (PARTITION BY repo) * 50) AS BIGINT)) AS trend
FROM (SELECT s.repo, s.b, coalesce(n, 0) AS n
  FROM (SELECT repo, CAST(unnest(generate_series(min(b), max(b), INTERVAL 1 MONTH)) AS DATE) AS b
        FROM bins GROUP BY repo) s LEFT JOIN bins c ON c.repo = s.repo AND c.b = s.b)
WINDOW w AS (PARTITION BY repo ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", "ord",
       extra=_bins("month"))
def a14(t):
    return commits.monthly_commits(t.orders)


DAYS = """(VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
  (6, 'Saturday'), (7, 'Sunday'))"""


@query("A15_weekday_counts", "repo day_number:l day_of_week commit_count:l", f"""
SELECT r.repo, d.i AS day_number, d.name AS day_of_week, coalesce(n, 0) AS commit_count
FROM (SELECT DISTINCT repo FROM ev) r CROSS JOIN {DAYS} d(i, name)
LEFT JOIN (SELECT repo, dayname(date) AS name, count(*) AS n FROM ev GROUP BY ALL) c
  ON c.repo = r.repo AND c.name = d.name""", "ev")
def a15_days(t):
    return commits.weekday_counts(t.events)


@query("A15_hour_counts", "repo hour:l commit_count:l",
       "SELECT repo, hour(date) AS hour, count(*) AS commit_count FROM ev GROUP BY ALL", "ev")
def a15_hours(t):
    return commits.hour_counts(t.events)


@query("A15_year_counts", "repo year:l commit_count:l",
       "SELECT repo, year(date) AS year, count(*) AS commit_count FROM ord GROUP BY ALL", "ord")
def a15_years(t):
    return commits.year_counts(t.orders)


BUSY = {"busy": f"""SELECT repo,
  arg_min(name, (-n, i)) AS day, max(n) AS day_n FROM (
    SELECT repo, name, i, count(*) AS n FROM (SELECT repo, dayname(date) AS name FROM ord)
    JOIN {DAYS} d(i, dn) ON dn = name GROUP BY ALL) GROUP BY repo""",
        "busy_hour": """SELECT repo, arg_min(h, (-n, h)) AS hour, max(n) AS hour_n FROM (
  SELECT repo, hour(date) AS h, count(*) AS n FROM ord GROUP BY ALL) GROUP BY repo"""}


@query("A14_commit_overview", "repo total_commits:l first_commit:t last_commit:t most_active_day "
       "most_active_day_count:l most_active_hour:l most_active_hour_count:l", """
SELECT t.repo, total_commits, first_commit, last_commit, day AS most_active_day,
  day_n AS most_active_day_count, hour AS most_active_hour, hour_n AS most_active_hour_count
FROM (SELECT repo, count(*) AS total_commits, min(date) AS first_commit, max(date) AS last_commit
      FROM ord GROUP BY repo) t JOIN busy USING (repo) JOIN busy_hour USING (repo)""", "ord",
       extra=BUSY)
def a14_overview(t):
    return commits.commit_overview(t.orders)


@query("A13_commit_patterns", "repo most_active_day most_active_day_count:l most_active_hour:l "
       "most_active_hour_count:l merge_commit_percentage:d avg_message_length:d trend", """
SELECT t.repo, day AS most_active_day, day_n AS most_active_day_count, hour AS most_active_hour,
  hour_n AS most_active_hour_count, merge_commit_percentage, avg_message_length, trend
FROM (SELECT c.repo, round(count(e.child) * 100.0::DOUBLE / count(*), 2) AS merge_commit_percentage,
        round(avg(length(message)), 2) AS avg_message_length
      FROM commits c LEFT JOIN (SELECT repo, child FROM edges WHERE place = 1) e
        ON c.repo = e.repo AND c.hash = e.child GROUP BY c.repo) t
JOIN busy USING (repo) JOIN busy_hour USING (repo)
JOIN (SELECT repo, string_agg(m || '=' || n, ',' ORDER BY m) AS trend FROM (
        SELECT repo, strftime(date, '%Y-%m') AS m, count(*) AS n FROM ord GROUP BY ALL)
      GROUP BY repo) USING (repo)""", "commits", "edges", extra=BUSY)
def a13(t):
    found = commits.commit_patterns(t.commits_with_parents)
    entries = F.transform(F.array_sort(F.map_entries("monthly_commit_trend")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.withColumn("trend", F.array_join(entries, ","))


@query("A16_activity_heatmap", "repo day_number:l day_of_week "
       + " ".join(f"h{h}:l" for h in range(24)), f"""
SELECT r.repo, d.i AS day_number, d.name AS day_of_week,
  {', '.join(f'count(*) FILTER (hour(date) = {h}) AS h{h}' for h in range(24))}
FROM (SELECT DISTINCT repo FROM ev) r CROSS JOIN {DAYS} d(i, name)
LEFT JOIN ev c ON c.repo = r.repo AND dayname(c.date) = d.name GROUP BY r.repo, d.i, d.name""", "ev")
def a16(t):
    return commits.activity_heatmap(t.events)


@query("A16_activity_peaks", "repo peak_activity_day peak_activity_hour:l total_activity_points:l", """
SELECT repo, day AS peak_activity_day, hour AS peak_activity_hour, n AS total_activity_points
FROM busy JOIN busy_hour USING (repo)
JOIN (SELECT repo, count(*) AS n FROM ord GROUP BY repo) USING (repo)""", "ord", extra=BUSY)
def a16_peaks(t):
    return commits.activity_peaks(t.orders)


@query("A17_monthly_active_contributors", "repo month active_contributors:l", """
SELECT s.repo, s.b AS month, coalesce(n, 0) AS active_contributors
FROM (SELECT repo, CAST(unnest(generate_series(min(b), max(b), INTERVAL 1 MONTH)) AS DATE) AS b
      FROM bins GROUP BY repo) s LEFT JOIN bins c ON c.repo = s.repo AND c.b = s.b""", "commits",
       extra={"bins": """SELECT repo, CAST(date_trunc('month', date) AS DATE) AS b,
         count(DISTINCT author_email) AS n FROM commits GROUP BY ALL"""})
def a17(t):
    return commits.monthly_active_contributors(t.commits)


@query("S14_newest_commits", "repo hash date:t", """
SELECT repo, hash, date FROM (SELECT *, row_number() OVER (PARTITION BY repo
  ORDER BY date DESC, hash) AS r FROM ord) WHERE r <= 1200""", "ord")
def s14(t):
    return commits.newest(t.orders, 1200)


@query("F15_J3_export_commits", "repo hash subject message_length:l is_merge:b files_changed:l "
       "insertions:l deletions:l lines_changed:l", """
SELECT c.repo, c.hash, message AS subject, length(message) AS message_length,
  e.child IS NOT NULL AS is_merge, files_changed, insertions, deletions, lines_changed
FROM commits c JOIN wide w ON c.repo = w.repo AND c.hash = w.hash
LEFT JOIN (SELECT repo, child FROM edges WHERE place = 1) e ON c.repo = e.repo AND c.hash = e.child
""", "commits", "wide", "edges")
def export(t):
    return commits.export_commits(t.commits_with_parents, t.changes)


# contributors

@query("A6_contributor_stats", "repo author_name author_email commit_count:l first_commit_date:t "
       "last_commit_date:t total_insertions:l total_deletions:l active_days:l", """
SELECT c.repo, author_name, author_email, count(DISTINCT hash) AS commit_count,
  min(date) AS first_commit_date, max(date) AS last_commit_date, sum(insertions) AS total_insertions,
  sum(deletions) AS total_deletions,
  date_diff('microsecond', min(date), max(date)) // 86400000000 AS active_days
FROM commits c JOIN changes f ON c.repo = f.repo AND c.hash = f.commit_hash
GROUP BY c.repo, author_name, author_email""", "commits", "changes")
def a6(t):
    return contributors.contributor_stats(t.commits, t.changes)


@query("A7_contributor_export", "repo author_name author_email commit_count:l first_commit_date:t "
       "last_commit_date:t total_insertions:l total_deletions:l total_lines_changed:l "
       "files_touched:l avg_lines_per_commit:d", """
SELECT c.repo, author_name, author_email, count(DISTINCT hash) AS commit_count,
  min(date) AS first_commit_date, max(date) AS last_commit_date,
  coalesce(sum(insertions), 0) AS total_insertions, coalesce(sum(deletions), 0) AS total_deletions,
  coalesce(sum(total_churn), 0) AS total_lines_changed, count(DISTINCT filepath) AS files_touched,
  round(coalesce(sum(total_churn), 0)::DOUBLE / count(DISTINCT hash), 2) AS avg_lines_per_commit
FROM commits c LEFT JOIN changes f ON c.repo = f.repo AND c.hash = f.commit_hash
GROUP BY c.repo, author_name, author_email""", "commits", "changes")
def a7(t):
    return contributors.contributor_export(t.commits, t.changes)


PEOPLE = {"people": """SELECT repo, author_email, count(*) AS commit_count,
  min(author_name) AS author_name, min(date) AS first_commit, max(date) AS last_commit
  FROM commits GROUP BY repo, author_email""",
          "people_ev": """SELECT repo, author_email, count(*) AS commit_count,
  min(author_name) AS author_name FROM ev GROUP BY repo, author_email"""}


@query("A8_W9_contributors_from_commits", "repo author_email commit_count:l author_name "
       "first_commit:t last_commit:t", "SELECT * FROM people", "commits", "ev", extra=PEOPLE)
def a8(t):
    return contributors.contributors_from_commits(t.commits)


@query("A9_active_contributors", "repo rank:l author_name author_email commit_count:l", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo
    ORDER BY commit_count DESC, author_name, author_email) AS rank
  FROM people_ev WHERE commit_count >= 5) WHERE rank <= 20""", "commits", "ev", extra=PEOPLE)
def a9(t):
    return contributors.active_contributors(contributors.contributors_from_commits(t.events))


@query("A9_contributor_overview", "repo total_contributors:l active_contributors:l top_contributor", """
SELECT a.repo, a.n AS total_contributors, least(20, b.n) AS active_contributors, top_contributor
FROM (SELECT repo, count(*) AS n FROM people_ev GROUP BY repo) a
JOIN (SELECT repo, count(*) AS n, arg_min(author_name, (-commit_count, author_name, author_email))
        AS top_contributor FROM people_ev WHERE commit_count >= 5 GROUP BY repo) b USING (repo)""",
       "commits", "ev", extra=PEOPLE)
def a9_overview(t):
    return contributors.contributor_overview(contributors.contributors_from_commits(t.events))


@query("A36_L3_top_contributors", "repo rank:l author_name commit_count:l", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo
    ORDER BY commit_count DESC, author_name, author_email) AS rank FROM people) WHERE rank <= 10""",
       "commits", "ev", extra=PEOPLE)
def a36(t):
    return contributors.top_contributors(contributors.contributors_from_commits(t.commits))


@query("C1_contributor_tiers", "repo tier contributors:l", """
SELECT r.repo, t.tier, count(p.repo) AS contributors
FROM (SELECT DISTINCT repo FROM people_ev) r
CROSS JOIN (VALUES ('Core (100+)'), ('Active (21-100)'), ('Regular (6-20)'), ('Casual (1-5)')) t(tier)
LEFT JOIN (SELECT repo, CASE WHEN commit_count < 6 THEN 'Casual (1-5)'
    WHEN commit_count < 21 THEN 'Regular (6-20)' WHEN commit_count < 100 THEN 'Active (21-100)'
    ELSE 'Core (100+)' END AS tier FROM people_ev) p ON p.repo = r.repo AND p.tier = t.tier
GROUP BY r.repo, t.tier""", "commits", "ev", extra=PEOPLE)
def c1(t):
    return contributors.contributor_tiers(contributors.contributors_from_commits(t.events))


@query("W3_pareto", "repo author_email commit_count:l position:l contributor_percent:d "
       "cumulative_percent:d", """
SELECT repo, author_email, commit_count, row_number() OVER w AS position,
  row_number() OVER w * 100.0::DOUBLE / count(*) OVER p AS contributor_percent,
  sum(commit_count) OVER w * 100.0::DOUBLE / sum(commit_count) OVER p AS cumulative_percent
FROM people WINDOW w AS (PARTITION BY repo ORDER BY commit_count DESC, author_email
  ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY repo)""", "commits", "ev", extra=PEOPLE)
def w3(t):
    return contributors.pareto(contributors.contributors_from_commits(t.commits))


# persistence and statistics

@query("M1_persistence_metrics", "repo hash age_days:l age_months:d churn_rate:d survival_rate:d "
       "asi:d", "SELECT * FROM metrics", "metrics")
def m1(t):
    return t.metrics


@query("W2_asi_trend", "repo date:t asi_trend:e", """
SELECT DISTINCT repo, date, avg(asi) OVER (PARTITION BY repo ORDER BY date
  RANGE BETWEEN INTERVAL 2591999999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS asi_trend
FROM metrics""", "metrics")
def w2(t):
    return persistence.asi_trend(t.metrics)


@query("A28_asi_summary", "repo avg_asi:d median_asi:d high_stability_commits:l "
       "low_stability_commits:l", """
SELECT repo, avg(asi) AS avg_asi, quantile_cont(asi, 0.5) AS median_asi,
  count(*) FILTER (asi > 0.8) AS high_stability_commits,
  count(*) FILTER (asi < 0.3) AS low_stability_commits FROM metrics GROUP BY repo""", "metrics")
def a28(t):
    return stats.asi_summary(t.metrics)


LONG = " UNION ALL ".join(
    f"SELECT repo, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM metrics" for m in stats.METRICS)


@query("A29_metric_summary", "repo metric count:l mean:d std:d min:d p25:d p50:d p75:d max:d", f"""
SELECT repo, metric, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
  min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.75) AS p75, max(value) AS max FROM ({LONG}) GROUP BY repo, metric""",
       "metrics")
def a29(t):
    return stats.describe(t.metrics)


CORR = " UNION ALL ".join(
    f"SELECT repo, '{x}' AS x, '{y}' AS y, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r "
    "FROM metrics GROUP BY repo" for x in stats.METRICS for y in stats.METRICS)


@query("A30_correlations", "repo x y r:d", CORR, "metrics")
def a30(t):
    return stats.correlations(t.metrics)


def _histogram_sql(table, value):
    return f"""
SELECT s.repo, s.bin, lo + (hi - lo) / 30 * (s.bin - 1) AS lower, lo + (hi - lo) / 30 * s.bin AS upper,
  coalesce(n, 0) AS count
FROM (SELECT repo, min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi,
        unnest(range(1, 31)) AS bin FROM {table} GROUP BY repo) s
LEFT JOIN (SELECT v.repo, least(30, CAST(floor((x - lo) / (hi - lo) * 30) AS BIGINT) + 1) AS bin,
    count(*) AS n
  FROM (SELECT repo, CAST({value} AS DOUBLE) AS x FROM {table}) v
  JOIN (SELECT repo, min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {table}
        GROUP BY repo) b USING (repo) GROUP BY ALL) c ON c.repo = s.repo AND c.bin = s.bin"""


HISTOGRAM = "repo bin:l lower:d upper:d count:l"


@query("A31_commit_histogram", HISTOGRAM, _histogram_sql("people", "commit_count"), "commits", "ev",
       extra=PEOPLE)
def a31(t):
    return stats.histogram(contributors.contributors_from_commits(t.commits), "commit_count")


@query("A31_asi_histogram", HISTOGRAM, _histogram_sql("metrics", "asi"), "metrics")
def a31_asi(t):
    return stats.histogram(t.metrics, "asi")


@query("A31_age_histogram", HISTOGRAM, _histogram_sql("metrics", "age_days"), "metrics")
def a31_age(t):
    return stats.histogram(t.metrics, "age_days")


@query("A31_median_commits", "repo median:d",
       "SELECT repo, quantile_cont(commit_count, 0.5) AS median FROM people GROUP BY repo",
       "commits", "ev", extra=PEOPLE)
def a31_median(t):
    return stats.median_line(contributors.contributors_from_commits(t.commits), "commit_count")


@query("A32_lines_by_asi", "repo side count:l q1:d median:d q3:d whisker_low:d whisker_high:d "
       "outliers:l", """
SELECT s.repo, s.side, count(*) AS count, any_value(q1) AS q1, any_value(median) AS median,
  any_value(q3) AS q3,
  least(any_value(q1), min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)))
    AS whisker_low,
  greatest(any_value(q3), max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)))
    AS whisker_high,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM sides s JOIN (SELECT repo, side, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
    quantile_cont(v, 0.75) AS q3 FROM sides GROUP BY ALL) q ON s.repo = q.repo AND s.side = q.side
GROUP BY s.repo, s.side""", "metrics", extra={"sides": """SELECT repo,
  CASE WHEN asi > 0.8 THEN 'high' ELSE 'low' END AS side, CAST(lines_changed AS DOUBLE) AS v
  FROM metrics WHERE asi > 0.8 OR asi < 0.3"""})
def a32(t):
    return stats.box_plot(t.metrics)

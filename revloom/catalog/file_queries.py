"""File analyses."""

from pyspark.sql import functions as F

from revloom.catalog.adapters import AS_OF
from revloom.catalog.registry import query
from revloom.operators import coupling, files, lifetimes

EXT_SQL = """CASE WHEN regexp_extract(regexp_replace(regexp_extract(filepath, '([^/]*)$', 1), '^\\.+', ''),
  '^[^.]+(\\..*[^.])$', 1) = '' THEN 'no_ext' ELSE lower(regexp_extract(regexp_replace(
  regexp_extract(filepath, '([^/]*)$', 1), '^\\.+', ''), '^[^.]+(\\..*[^.])$', 1)) END"""

LANG_SQL = """CASE regexp_extract(filepath, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'Python'
  WHEN '.js' THEN 'JavaScript' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON'
  WHEN '.yaml' THEN 'YAML' WHEN '.css' THEN 'CSS' ELSE 'Other' END"""

COUNTS = {"counts": """SELECT repo, filepath, count(*) AS change_count FROM changes
  GROUP BY repo, filepath"""}


@query("A1_core_files", "repo filepath presence_percentage:d", """
SELECT l.repo, filepath, present / total AS presence_percentage FROM (
  SELECT l.repo, filepath, sum(coalesce(to_seq, total + 1) - from_seq) AS present,
    max(total)::DOUBLE AS total
  FROM lifetimes l JOIN (SELECT repo, max(seq) AS total FROM seq GROUP BY repo) t ON l.repo = t.repo
  GROUP BY l.repo, filepath) l WHERE present / total >= 0.9""", "lifetimes")
def a1(t):
    counts = lifetimes.presence_counts(t.lifetimes, t.sequence)
    return files.core_files(counts, t.orders, 0.9)


@query("A2_volatile_files", "repo filepath commit_count:l", """
SELECT repo, filepath, count(*) AS commit_count FROM changes GROUP BY repo, filepath
HAVING count(*) >= 10""", "changes")
def a2(t):
    return files.volatile_files(t.changes, 10)


@query("A3_file_churn", "repo filepath total_insertions:l total_deletions:l total_churn:l "
       "commit_count:l avg_churn_per_commit:d", """
SELECT repo, filepath, sum(insertions) AS total_insertions, sum(deletions) AS total_deletions,
  sum(total_churn) AS total_churn, count(DISTINCT commit_hash) AS commit_count,
  sum(total_churn)::DOUBLE / count(DISTINCT commit_hash) AS avg_churn_per_commit
FROM changes GROUP BY repo, filepath""", "changes")
def a3(t):
    return files.file_churn(t.changes)


@query("A4_complexity_timeline", "repo hash date:t total_files:l",
       "SELECT repo, hash, date, total_files FROM timeline", "timeline")
def a4(t):
    return lifetimes.complexity_timeline(t.lifetimes, t.sequence)


@query("A11_W5_language_statistics", "repo language file_count:l percentage:d", f"""
SELECT repo, language, n AS file_count, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY repo), 2)
  AS percentage
FROM (SELECT repo, {LANG_SQL} AS language, count(*) AS n FROM head
      WHERE NOT filepath LIKE '%.png' GROUP BY ALL)""", "head")
def a11(t):
    return files.language_statistics(lifetimes.head_files(t.lifetimes))


@query("A12_language_distribution", "repo language change_count:l percentage:d", f"""
SELECT repo, language, n AS change_count, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY repo)
  AS percentage
FROM (SELECT repo, {LANG_SQL} AS language, count(*) AS n FROM changes GROUP BY ALL)""", "changes")
def a12(t):
    return files.language_distribution(t.changes)


@query("J10_language_lookup", "repo language change_count:l", f"""
SELECT repo, {LANG_SQL} AS language, count(*) AS change_count FROM changes GROUP BY ALL""", "changes")
def j10(t):
    return files.with_language(t.changes).groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("change_count"))


@query("A18_monthly_extensions", "repo month file_extension change_count:l", """
SELECT m.repo, m.month, k.file_extension, coalesce(c.n, 0) AS change_count
FROM (SELECT DISTINCT repo, month FROM cells) m
JOIN (SELECT repo, file_extension FROM (SELECT repo, file_extension, row_number() OVER (
        PARTITION BY repo ORDER BY n DESC, file_extension) AS r FROM (
          SELECT repo, file_extension, sum(n) AS n FROM cells GROUP BY ALL)) WHERE r <= 8) k ON m.repo = k.repo
LEFT JOIN cells c ON c.repo = m.repo AND c.month = m.month AND c.file_extension = k.file_extension
""", "changes", "ord", extra={"cells": f"""SELECT c.repo,
  CAST(date_trunc('month', date) AS DATE) AS month, {EXT_SQL} AS file_extension, count(*) AS n
  FROM changes c JOIN ord o ON c.repo = o.repo AND c.commit_hash = o.hash GROUP BY ALL"""})
def a18(t):
    return files.monthly_extensions(files.date_changes(t.changes, t.orders), 8)


@query("A18_monthly_extension_matrix", "repo month file_extension change_count:l", f"""
SELECT c.repo, CAST(date_trunc('month', date) AS DATE) AS month, {EXT_SQL} AS file_extension,
  count(*) AS change_count
FROM changes c JOIN ord o ON c.repo = o.repo AND c.commit_hash = o.hash GROUP BY ALL""",
       "changes", "ord")
def a18_all(t):
    return files.monthly_extensions(files.date_changes(t.changes, t.orders), None)


@query("A19_extension_counts", "repo file_extension change_count:l rank:l", f"""
SELECT * FROM (SELECT repo, file_extension, n AS change_count,
    row_number() OVER (PARTITION BY repo ORDER BY n DESC, file_extension) AS rank
  FROM (SELECT repo, {EXT_SQL} AS file_extension, count(*) AS n FROM changes GROUP BY ALL))
WHERE rank <= 10""", "changes")
def a19(t):
    return files.extension_counts(t.changes, 10)


@query("A19_change_overview", "repo total_file_changes:l unique_files:l most_active_extension", f"""
SELECT a.repo, total_file_changes, unique_files, file_extension AS most_active_extension
FROM (SELECT repo, count(*) AS total_file_changes, count(DISTINCT filepath) AS unique_files
      FROM changes GROUP BY repo) a
JOIN (SELECT repo, file_extension, row_number() OVER (PARTITION BY repo
        ORDER BY n DESC, file_extension) AS r
      FROM (SELECT repo, {EXT_SQL} AS file_extension, count(*) AS n FROM changes GROUP BY ALL)) b
  ON a.repo = b.repo AND r = 1""", "changes")
def a19_overview(t):
    return files.change_overview(t.changes)


@query("A20_directory_activity", "repo directory change_count:l rank:l", """
SELECT * FROM (SELECT repo, directory, n AS change_count,
    row_number() OVER (PARTITION BY repo ORDER BY n DESC, directory) AS rank
  FROM (SELECT repo, regexp_replace(filepath, '/[^/]*$', '') AS directory, count(*) AS n
        FROM changes GROUP BY ALL)) WHERE rank <= 15""", "changes")
def a20(t):
    return files.directory_activity(t.changes)


@query("A21_depth_distribution", "repo path_depth:l change_count:l", """
SELECT repo, len(string_split(filepath, '/')) AS path_depth, count(*) AS change_count
FROM changes GROUP BY ALL""", "changes")
def a21(t):
    return files.depth_distribution(t.changes)


@query("A22_top_changed_files", "repo filepath change_count:l rank:l", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY change_count DESC, filepath)
  AS rank FROM counts) WHERE rank <= 20""", "changes", extra=COUNTS)
def a22(t):
    return files.top_changed_files(t.changes, 20)


@query("A22_change_frequency", "repo total_hotspots:l critical_hotspots:l most_changed_file "
       "max_changes:l", """
SELECT c.repo, count(*) AS total_hotspots, count(*) FILTER (change_count >= p95) AS critical_hotspots,
  arg_min(filepath, (-change_count, filepath)) AS most_changed_file, max(change_count) AS max_changes
FROM counts c JOIN (SELECT repo, quantile_cont(change_count, 0.95) AS p95 FROM counts GROUP BY repo) q
  ON c.repo = q.repo GROUP BY c.repo""", "changes", extra=COUNTS)
def a22_summary(t):
    return files.change_frequency_summary(t.changes)


HEAT_SQL = """SELECT c.repo, filepath, change_count,
  CASE WHEN change_count <= p50 THEN 'Stable' WHEN change_count <= p80 THEN 'Active'
       WHEN change_count <= p95 THEN 'Hot' ELSE 'Critical' END AS category
FROM counts c JOIN (SELECT repo, quantile_cont(change_count, 0.5) AS p50,
    quantile_cont(change_count, 0.8) AS p80, quantile_cont(change_count, 0.95) AS p95
  FROM counts GROUP BY repo) q ON c.repo = q.repo"""


@query("C2_file_heat", "repo filepath change_count:l category", HEAT_SQL, "changes", extra=COUNTS)
def c2(t):
    return files.file_heat(t.changes)


@query("C2_file_heat_counts", "repo category file_count:l", f"""
SELECT repo, category, count(*) AS file_count FROM ({HEAT_SQL}) GROUP BY ALL""", "changes",
       extra=COUNTS)
def c2_counts(t):
    return files.file_heat_counts(t.changes)


HOT_SQL = """
SELECT f.repo, filepath, rc AS recent_commits, ch AS total_churn, ua AS unique_authors,
  rc::DOUBLE / max(rc) OVER w + ch::DOUBLE / max(ch) OVER w + ua::DOUBLE / max(ua) OVER w AS risk_score
FROM (SELECT c.repo, filepath, count(DISTINCT commit_hash) AS rc, sum(total_churn) AS ch,
        count(DISTINCT o_custkey) AS ua
      FROM changes c JOIN ord o ON c.repo = o.repo AND c.commit_hash = o.hash
      {clock}
      GROUP BY c.repo, filepath) f WINDOW w AS (PARTITION BY repo)"""


@query("A23_J2_W4_recent_hotspots", "repo filepath recent_commits:l total_churn:l unique_authors:l "
       "risk_score:d", HOT_SQL.format(clock="""JOIN (SELECT repo, max(date) AS clock FROM ord
        GROUP BY repo) k ON k.repo = c.repo AND o.date >= clock - INTERVAL 180 DAY"""),
       "changes", "ord")
def a23(t):
    return files.hotspot_files(t.changes, t.commits)


@query("A23_P16_hotspots_as_of", "repo filepath recent_commits:l total_churn:l unique_authors:l "
       "risk_score:d", HOT_SQL.format(
           clock=f"WHERE o.date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"), "changes", "ord")
def a23_fixed(t):
    return files.hotspot_files(t.changes, t.commits, AS_OF, 365)


@query("A35_group_by_directory", "repo directory filepath", """
SELECT DISTINCT repo, split_part(filepath, '/', 1) || '/' || split_part(filepath, '/', 2) AS directory,
  filepath FROM changes""", "changes")
def a35(t):
    return files.group_by_directory(t.changes.select("repo", "filepath").distinct(), 2)


@query("A37_J11_languages_with_others", "repo language file_count:l", f"""
SELECT repo, CASE WHEN r <= 3 THEN language ELSE 'Others' END AS language, sum(n) AS file_count
FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS r FROM (
  SELECT repo, {LANG_SQL} AS language, count(*) AS n FROM head WHERE NOT filepath LIKE '%.png'
  GROUP BY ALL)) GROUP BY ALL""", "head")
def a37(t):
    stats = files.language_statistics(lifetimes.head_files(t.lifetimes))
    return files.language_shares_with_others(stats, 3)


COUPLING_SQL = """SELECT a.repo, a.filepath AS file1, b.filepath AS file2, count(*)
  AS times_changed_together
FROM d a JOIN d b ON a.repo = b.repo AND a.commit_hash = b.commit_hash AND a.filepath < b.filepath
GROUP BY ALL HAVING count(*) >= {n}"""
DISTINCT = {"d": "SELECT DISTINCT repo, commit_hash, filepath FROM changes"}


@query("J8_co_changes", "repo file1 file2 times_changed_together:l", COUPLING_SQL.format(n=1),
       "changes", extra=DISTINCT)
def j8(t):
    return coupling.file_coupling(t.changes, 1)


@query("K9_file_coupling", "repo file1 file2 times_changed_together:l", COUPLING_SQL.format(n=2),
       "changes", extra=DISTINCT)
def k9(t):
    return coupling.file_coupling(t.changes, 2)


@query("K1_file_lifetimes", "repo filepath from_seq:l to_seq:l",
       "SELECT repo, filepath, from_seq, to_seq FROM lifetimes", "lifetimes")
def k1(t):
    return t.lifetimes


@query("S7_head_files", "repo filepath", "SELECT repo, filepath FROM head", "head")
def s7(t):
    return lifetimes.head_files(t.lifetimes)


LAST = {"last": """SELECT repo, filepath, x.date AS last_modified, x.name AS last_author FROM (
  SELECT c.repo, filepath, max({'date': date, 'hash': hash, 'name': author_name}) AS x
  FROM changes c JOIN commits o ON c.repo = o.repo AND c.commit_hash = o.hash
  GROUP BY c.repo, filepath)"""}


@query("W8_last_change_per_file", "repo filepath last_modified:t last_author",
       "SELECT * FROM last", "changes", "commits", extra=LAST)
def w8(t):
    return lifetimes.last_changes(t.changes, t.commits)


@query("K2_stable_files", "repo filepath last_modified:t", f"""
SELECT l.repo, l.filepath, last_modified FROM last l
JOIN head h ON l.repo = h.repo AND l.filepath = h.filepath
WHERE last_modified < TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY""", "head", "commits", extra=LAST)
def k2(t):
    return lifetimes.stable_files(lifetimes.head_files(t.lifetimes),
                                  lifetimes.last_changes(t.changes, t.commits), t.orders, 365, AS_OF)


@query("K3_abandoned_files", "repo filepath last_modified:t days_since_change:l last_author", """
SELECT l.repo, l.filepath, last_modified,
  date_diff('microsecond', last_modified, clock) // 86400000000 AS days_since_change, last_author
FROM last l JOIN head h ON l.repo = h.repo AND l.filepath = h.filepath
JOIN (SELECT repo, max(date) AS clock FROM commits GROUP BY repo) k ON k.repo = l.repo
WHERE last_modified < clock - INTERVAL 730 DAY""", "head", "commits", extra=LAST)
def k3(t):
    return lifetimes.abandoned_files(lifetimes.head_files(t.lifetimes),
                                     lifetimes.last_changes(t.changes, t.commits), t.orders, 730)


@query("K4_reorganisations", "repo commit_hash date:t message files_moved:l move_ratio:d", """
SELECT m.repo, m.commit_hash, t.date, c.message, n AS files_moved, n::DOUBLE / total_files AS move_ratio
FROM (SELECT repo, commit_hash, count(*) AS n FROM changes WHERE change_type = 'R' GROUP BY ALL) m
JOIN timeline t ON m.repo = t.repo AND m.commit_hash = t.hash
JOIN commits c ON m.repo = c.repo AND m.commit_hash = c.hash
WHERE total_files > 0 AND n::DOUBLE / total_files >= 0.002 AND seq > 1""", "timeline", "commits")
def k4(t):
    timeline = lifetimes.complexity_timeline(t.lifetimes, t.sequence)
    return lifetimes.reorganisations(t.changes, timeline, t.commits, 0.002)

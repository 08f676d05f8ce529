"""Snapshots, trees, graph, report tables."""

from pyspark.sql import functions as F

from revloom.catalog.adapters import AS_OF
from revloom.catalog.registry import query
from revloom.functions import scalars
from revloom.operators import ancestry, contributors, files, lifetimes, report, snapshots
from revloom.sources.tables import History, branch_history

TARGETS = {"targets": """SELECT DISTINCT repo, strftime(day, '%Y-%m-%d') AS snapshot_id,
  day + INTERVAL 12 HOUR AS target FROM (
    SELECT CASE WHEN l_orderkey % 8 < 3 THEN 'core' ELSE 'lib' || (l_orderkey % 8) END AS repo,
      CAST(l_shipdate AS TIMESTAMP) - INTERVAL 200 DAY AS day FROM lineitem)"""}

ASOF = {"best": """SELECT repo, date, max(hash) AS hash FROM ord GROUP BY repo, date""",
        "placed": """SELECT t.repo, t.snapshot_id, t.target, coalesce(b.hash, f.hash) AS commit_hash
  FROM targets t ASOF LEFT JOIN best b ON t.repo = b.repo AND t.target >= b.date
  JOIN (SELECT repo, arg_min(hash, (date, hash)) AS hash FROM ord GROUP BY repo) f
    ON f.repo = t.repo"""}


def _daily_targets(t):
    day = F.col("l_shipdate") - F.make_dt_interval(F.lit(200))
    return t.lineitem.select(
        "repo", F.date_format(day.cast("timestamp"), "yyyy-MM-dd").alias("snapshot_id"),
        (day + F.make_dt_interval(hours=F.lit(12))).cast("timestamp").alias("target")).distinct()


@query("J9_commit_as_of", "repo snapshot_id target:t commit_hash timestamp:t author commit_message", """
SELECT a.repo, snapshot_id, target, commit_hash, c.date AS timestamp, author_name AS author,
  message AS commit_message FROM placed a JOIN commits c ON a.repo = c.repo AND a.commit_hash = c.hash""",
       "commits", extra={**TARGETS, **ASOF})
def j9(t):
    return snapshots.commit_as_of(_daily_targets(t), t.commits)


REACH = {"reach": """SELECT DISTINCT repo, last_commit_hash AS head, last_commit_hash AS hash FROM branches
  UNION SELECT r.repo, r.head, e.parent FROM reach r JOIN edges e ON e.repo = r.repo
    AND e.child = r.hash"""}


def _heads(t):
    return t.branches.select("repo", F.col("last_commit_hash").alias("hash"))


YEARLY = {"targets": """SELECT DISTINCT repo, CAST(year(date) AS VARCHAR) AS snapshot_id,
  make_timestamp(year(date), 7, 1, 0, 0, 0) AS target FROM ord""", **ASOF,
          "snap": """SELECT a.repo, a.snapshot_id, l.filepath
  FROM placed a JOIN seq s ON s.repo = a.repo AND s.hash = a.commit_hash
  JOIN lifetimes l ON l.repo = a.repo AND l.from_seq <= s.seq
    AND (l.to_seq IS NULL OR s.seq < l.to_seq)"""}


def _yearly_commits(t):
    years = t.orders.select("repo", F.year("date").alias("y")).distinct()
    targets = years.select("repo", F.col("y").cast("string").alias("snapshot_id"),
                           F.make_timestamp("y", F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
                           .alias("target"))
    return snapshots.commit_as_of(targets, t.commits)


def _yearly(t):
    return snapshots.snapshot_files(_yearly_commits(t), t.sequence, t.lifetimes)


@query("K6_snapshot_files", "repo snapshot_id filepath", "SELECT * FROM snap", "lifetimes",
       extra=YEARLY)
def k6(t):
    return _yearly(t)


@query("K6_snapshot_headers", "repo snapshot_id commit_hash timestamp:t author commit_message branch "
       "total_files:l", """
SELECT a.repo, a.snapshot_id, a.commit_hash, c.date AS timestamp, author_name AS author,
  message AS commit_message, branch, coalesce(n, 0) AS total_files
FROM placed a JOIN commits c ON c.repo = a.repo AND c.hash = a.commit_hash
LEFT JOIN (SELECT repo, snapshot_id, count(*) AS n FROM snap GROUP BY ALL) s
  ON s.repo = a.repo AND s.snapshot_id = a.snapshot_id
LEFT JOIN (SELECT r.repo, r.hash, min(b.branch_name) AS branch FROM reach r
    JOIN branches b ON b.repo = r.repo AND b.last_commit_hash = r.head AND NOT b.is_remote
    GROUP BY r.repo, r.hash) h ON h.repo = a.repo AND h.hash = a.commit_hash""",
       "commits", "lifetimes", "edges", "branches", extra={**YEARLY, **REACH})
def k6_headers(t):
    found = _yearly_commits(t)
    held = ancestry.branch_of_commit(t.orders, t.branches, t.edges)
    files_found = snapshots.snapshot_files(found, t.sequence, t.lifetimes)
    return snapshots.snapshot_headers(found, files_found, held)


@query("K5_L4_directory_tree", "repo snapshot_id path parent_path depth:l name type children:l "
       "sort_key", """
SELECT n.repo, n.snapshot_id, n.path, n.parent_path, n.depth, n.name, n.type,
  CASE WHEN n.type = 'directory' THEN c.n END AS children, n.sort_key
FROM nodes n LEFT JOIN (SELECT repo, snapshot_id, parent_path, count(*) AS n FROM nodes GROUP BY ALL) c
  ON c.repo = n.repo AND c.snapshot_id = n.snapshot_id AND c.parent_path = n.path""", "lifetimes",
       extra={**YEARLY, "nodes": """
SELECT repo, snapshot_id, filepath AS path, regexp_replace(filepath, '/[^/]*$', '') AS parent_path,
  3 AS depth, split_part(filepath, '/', 3) AS name, 'file' AS type,
  '0' || split_part(filepath, '/', 1) || '|0' || split_part(filepath, '/', 2) || '|1'
    || split_part(filepath, '/', 3) AS sort_key FROM snap
UNION ALL SELECT DISTINCT repo, snapshot_id, regexp_replace(filepath, '/[^/]*$', ''),
  split_part(filepath, '/', 1), 2, split_part(filepath, '/', 2), 'directory',
  '0' || split_part(filepath, '/', 1) || '|0' || split_part(filepath, '/', 2) FROM snap
UNION ALL SELECT DISTINCT repo, snapshot_id, split_part(filepath, '/', 1), '', 1,
  split_part(filepath, '/', 1), 'directory', '0' || split_part(filepath, '/', 1) FROM snap"""})
def k5(t):
    return snapshots.directory_tree(_yearly(t)).withColumn(
        "sort_key", F.replace("sort_path", F.lit("\u0001"), F.lit("|")))


@query("K5_directory_totals", "repo snapshot_id path total_files:l total_size:l", """
SELECT repo, snapshot_id, path, count(*) AS total_files, sum(length(filepath)) AS total_size FROM (
  SELECT *, unnest(['', split_part(filepath, '/', 1), regexp_replace(filepath, '/[^/]*$', '')]) AS path FROM snap)
GROUP BY ALL""", "lifetimes", extra=YEARLY)
def k5_totals(t):
    return snapshots.directory_totals(_yearly(t).withColumn("size", F.length("filepath").cast("long")))


_NODE = """'{"name":"' || name || '","path":"' || path || '","type":"' || type || '","size":' || size
  || ',"mode":null,"content_preview":null'"""


@query("S12_snapshot_documents", "repo snapshot_id document", f"""
SELECT repo, snapshot_id, '{{"name":"","path":"","type":"directory","size":null,"mode":null,"content_preview":null,"children":{{'
  || string_agg(node, ',' ORDER BY path) || '}}}}' AS document FROM (
  SELECT repo, snapshot_id, path, '"' || path || '":' || {_NODE} || ',"children":{{'
    || string_agg(node, ',' ORDER BY name2) || '}}}}' AS node FROM (
    SELECT repo, snapshot_id, split_part(path, '/', 1) AS path, split_part(path, '/', 1) AS name, 'directory' AS type,
      'null' AS size, name AS name2, '"' || name || '":' || {_NODE} || ',"children":{{'
      || string_agg(node, ',' ORDER BY name3) || '}}}}' AS node FROM (
      SELECT repo, snapshot_id, regexp_replace(path, '/[^/]*$', '') AS path, split_part(path, '/', 2) AS name,
        'directory' AS type, 'null' AS size, name AS name3, '"' || name || '":' || {_NODE} || '}}' AS node FROM (
        SELECT repo, snapshot_id, filepath AS path, split_part(filepath, '/', 3) AS name, 'file' AS type,
          CAST(length(filepath) AS VARCHAR) AS size FROM snap))
    GROUP BY repo, snapshot_id, path, name, type, size) GROUP BY repo, snapshot_id, path, name, type, size)
GROUP BY repo, snapshot_id""", "lifetimes", extra=YEARLY)
def s12_documents(t):
    parts = snapshots.snapshot_documents(_yearly(t).withColumn("size", F.length("filepath").cast("long")), 100)
    return parts.groupBy("repo", "snapshot_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("document"))


@query("A33_snapshot_stats", "repo snapshot_id total_files:l total_size:l size_text types", """
SELECT repo, snapshot_id, total_files, total_size, printf('%.1f', total_size / 1024.0) || 'KB' AS size_text,
  types FROM (
  SELECT repo, snapshot_id, CAST(sum(n) AS BIGINT) AS total_files, CAST(sum(s) AS BIGINT) AS total_size,
    string_agg(ext || '=' || n, ',' ORDER BY ext) AS types
  FROM (SELECT repo, snapshot_id, CASE WHEN filepath LIKE '%.%' THEN '.' || split_part(filepath, '.', 2)
          ELSE 'no_ext' END AS ext, count(*) AS n, sum(length(filepath)) AS s
        FROM snap GROUP BY ALL) GROUP BY ALL)""", "lifetimes", extra=YEARLY)
def a33(t):
    sized = _yearly(t).withColumn("size", F.length("filepath").cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("file_types")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return snapshots.snapshot_stats(sized).withColumns(
        {"types": text, "size_text": scalars.human_size("total_size")})


PREVIEW_SQL = """
SELECT repo, filepath, CASE WHEN text = '' THEN NULL
  WHEN contains(text, chr(0)) THEN '<binary file, ' || length(text) || ' bytes>' ELSE
  CASE WHEN length(head) > 500 THEN substr(head, 1, 500) || '...' ELSE head END
  || CASE WHEN n > 5 THEN chr(10) || '... (' || (n - 5) || ' more lines)' ELSE '' END END
  AS content_preview
FROM (SELECT *, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS head,
        len(string_split(text, chr(10))) AS n FROM contents)"""


@query("F13_content_preview", "repo filepath content_preview", PREVIEW_SQL, "contents")
def f13(t):
    return t.contents.withColumn("content_preview", scalars.content_preview("text"))


@query("K6_files_with_previews", "repo filepath content_preview", PREVIEW_SQL, "contents")
def k6_preview(t):
    return snapshots.with_previews(t.contents.select("repo", "filepath"), t.contents)


@query("K8_ancestor_reachability", "repo head hash", "SELECT * FROM reach", "edges", "branches",
       extra=REACH)
def k8(t):
    return ancestry.reachable(t.edges, _heads(t))


@query("K7_W7_branch_facts", "repo branch_name full_name is_current:b is_remote:b last_commit_hash "
       "commit_count:l is_merged:b", """
SELECT u.repo, u.branch_name, full_name, is_current, is_remote, u.last_commit_hash, n AS commit_count,
  NOT is_remote AND u.branch_name <> 'main' AND i.hash IS NOT NULL AS is_merged
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch_name
        ORDER BY is_remote, full_name) AS r FROM branches) WHERE r = 1) u
JOIN (SELECT repo, head, count(*) AS n FROM reach GROUP BY ALL) c
  ON c.repo = u.repo AND c.head = u.last_commit_hash
LEFT JOIN (SELECT r.repo, r.hash FROM reach r JOIN branches b ON b.repo = r.repo
      AND b.branch_name = 'main' AND b.last_commit_hash = r.head) i
  ON i.repo = u.repo AND i.hash = u.last_commit_hash""", "edges", "branches", extra=REACH)
def k7(t):
    return ancestry.branch_facts(t.branches, t.edges, ancestry.choose_branch(t.branches))


@query("K7_branch_of_commit", "repo hash branch", """
SELECT o.repo, o.hash, min(b.branch_name) AS branch FROM ord o
LEFT JOIN reach r ON r.repo = o.repo AND r.hash = o.hash
LEFT JOIN branches b ON b.repo = r.repo AND b.last_commit_hash = r.head AND NOT b.is_remote
GROUP BY o.repo, o.hash""", "edges", "branches", extra=REACH)
def k7_commit(t):
    return ancestry.branch_of_commit(t.orders, t.branches, t.edges)


@query("W7_unique_branches", "repo branch_name full_name is_remote:b last_commit_hash", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch_name
  ORDER BY is_remote, full_name) AS r FROM branches) WHERE r = 1""", "branches")
def w7(t):
    return ancestry.unique_branches(t.branches)


@query("A10_repository_stats", "repo total_commits:l total_branches:l total_tags:l "
       "first_commit_date:t last_commit_date:t age_in_days:l unique_authors:l total_files_current:l",
       f"""
SELECT c.*, date_diff('microsecond', first_commit_date, TIMESTAMP '{AS_OF}') // 86400000000
    AS age_in_days, total_branches, total_tags, total_files_current
FROM (SELECT repo, count(*) AS total_commits, min(date) AS first_commit_date,
        max(date) AS last_commit_date, count(DISTINCT author_email) AS unique_authors
      FROM commits GROUP BY repo) c
JOIN (SELECT repo, count(*) AS total_branches FROM branches GROUP BY repo) USING (repo)
JOIN (SELECT repo, count(*) AS total_tags FROM tags GROUP BY repo) USING (repo)
JOIN (SELECT repo, count(*) AS total_files_current FROM head GROUP BY repo) USING (repo)""",
       "commits", "branches", "tags", "head")
def a10(t):
    return lifetimes.repository_stats(t.commits, lifetimes.head_files(t.lifetimes), t.branches,
                                      t.tags, AS_OF)


# report tables

REPORT = {"fm": """SELECT *, date_diff('microsecond', last_modified_date, clock) // 86400000000
    AS days_since_last_change, commit_count * (1 + mean_asi) AS impact_score FROM (
  SELECT c.repo, filepath, count(DISTINCT commit_hash) AS commit_count,
    max(m.date) AS last_modified_date, avg(asi) AS mean_asi
  FROM changes c JOIN metrics m ON c.repo = m.repo AND c.commit_hash = m.hash
  GROUP BY c.repo, filepath) JOIN (SELECT repo, max(date) AS clock FROM metrics GROUP BY repo)
  USING (repo)""",
          "th": """SELECT repo, greatest(10, CAST(floor(p90) AS BIGINT)) AS high_churn,
    least(180, CAST(floor(age * 0.25) AS BIGINT)) AS stable_days
  FROM (SELECT repo, quantile_cont(n, 0.9) AS p90 FROM (
          SELECT repo, filepath, count(*) AS n FROM changes GROUP BY ALL) GROUP BY repo)
  JOIN (SELECT repo, date_diff('microsecond', min(date), max(date)) // 86400000000 AS age
        FROM metrics GROUP BY repo) USING (repo)""",
          "hot": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo
    ORDER BY round(impact_score, 9) DESC, filepath) AS rank FROM fm) WHERE rank <= 15""",
          "topics": """SELECT *, CASE
    WHEN regexp_matches(filepath, 'package\\.json|package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock')
      THEN 'Package Management'
    WHEN regexp_matches(filepath, '\\.js|\\.ts|\\.py') AND NOT contains(filepath, 'test')
      THEN 'Core Logic'
    WHEN regexp_matches(filepath, '\\.yml|\\.yaml|\\.json|dockerfile|makefile') THEN 'Configuration'
    WHEN regexp_matches(filepath, '\\.css|\\.html|\\.vue|\\.jsx|\\.tsx') THEN 'UI/Frontend'
    WHEN regexp_matches(filepath, 'readme|changelog|\\.md') THEN 'Documentation' ELSE 'Other' END
    AS topic FROM hot""",
          "study": """SELECT * EXCLUDE (rank, r), r AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY repo, topic ORDER BY round(impact_score, 9) DESC, filepath) AS r FROM topics)
    WHERE r <= 3""",
          "good": """SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.repo
    ORDER BY commit_count DESC, f.filepath) AS rank FROM fm f JOIN th ON th.repo = f.repo
    ANTI JOIN hot h ON h.repo = f.repo AND h.filepath = f.filepath
    WHERE commit_count > high_churn) WHERE rank <= 5""",
          "alone": """SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.repo
    ORDER BY days_since_last_change DESC, f.filepath) AS rank FROM fm f JOIN th ON th.repo = f.repo
    WHERE days_since_last_change > stable_days) WHERE rank <= 5"""}


def _metrics(t):
    # scores are compared at nine digits: the mean of the index depends on the order of summation
    found = report.file_metrics(t.changes, t.metrics)
    return found.withColumn("impact_score", F.round("impact_score", 9))


def _report(key, columns, sql):
    return query(key, columns, sql, "changes", "metrics", extra=REPORT)


@_report("A24_J7_file_metrics", "repo filepath commit_count:l last_modified_date:t mean_asi:e "
         "days_since_last_change:l impact_score:e", "SELECT * FROM fm")
def a24(t):
    return report.file_metrics(t.changes, t.metrics)


@_report("A25_adaptive_thresholds", "repo high_churn:l stable_days:l", "SELECT * FROM th")
def a25(t):
    return report.adaptive_thresholds(t.orders, t.changes)


@_report("A26_stable_files", "repo filepath days_since_last_change:l", """
SELECT f.repo, filepath, days_since_last_change FROM fm f JOIN th ON th.repo = f.repo
WHERE days_since_last_change > stable_days""")
def a26_stable(t):
    return report.stable_list(_metrics(t), report.adaptive_thresholds(t.orders, t.changes))


@_report("A26_volatile_files", "repo filepath commit_count:l", """
SELECT f.repo, filepath, commit_count FROM fm f JOIN th ON th.repo = f.repo
WHERE commit_count > high_churn""")
def a26_volatile(t):
    return report.volatile_list(_metrics(t), report.adaptive_thresholds(t.orders, t.changes))


@_report("A26_hotspots", "repo rank:l filepath commit_count:l impact_score:e", """
SELECT round(impact_score, 9) AS impact_score, * EXCLUDE (impact_score) FROM hot""")
def a26_hot(t):
    return report.hotspot_list(_metrics(t))


@_report("C3_hotspot_topics", "repo rank:l filepath topic", "SELECT * FROM topics")
def c3(t):
    return report.hotspot_topics(_metrics(t))


@_report("W6_study_first", "repo topic rank:l filepath", "SELECT * FROM study")
def w6(t):
    return report.study_first(_metrics(t))


@_report("C7_J6_onboarding", "repo list topic rank:l filepath", """
SELECT repo, 'study first' AS list, topic, rank, filepath FROM study
UNION ALL SELECT repo, 'good first files', NULL, rank, filepath FROM good
UNION ALL SELECT repo, 'leave alone', NULL, rank, filepath FROM alone""")
def c7(t):
    return report.onboarding(_metrics(t), report.adaptive_thresholds(t.orders, t.changes))


@query("A27_C4_C5_repository_health", "repo total_commits:l total_contributors:l repo_age_days:l "
       "commits_per_year:d activity community", """
SELECT *, CASE WHEN commits_per_year > 500 THEN 'High Activity'
    WHEN commits_per_year > 100 THEN 'Moderate Activity' ELSE 'Low Activity' END AS activity,
  CASE WHEN total_contributors > 100 THEN 'Strong Community'
    WHEN total_contributors > 20 THEN 'Active Community' ELSE 'Small Team' END AS community
FROM (SELECT *, total_commits / greatest(repo_age_days / 365.25::DOUBLE, 1.0::DOUBLE) AS commits_per_year
      FROM (SELECT repo, count(*) AS total_commits, count(DISTINCT author_email) AS total_contributors,
        date_diff('microsecond', min(date), max(date)) // 86400000000 AS repo_age_days
      FROM commits GROUP BY repo))""", "commits")
def a27(t):
    return report.repository_health(t.commits)


LANGUAGES = {"dist": """SELECT repo, language, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY repo)
  AS percentage FROM (SELECT repo, CASE regexp_extract(filepath, '(\\.[^./]+)$', 1)
    WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.md' THEN 'Markdown'
    WHEN '.json' THEN 'JSON' WHEN '.yaml' THEN 'YAML' WHEN '.css' THEN 'CSS' ELSE 'Other' END
    AS language, count(*) AS n FROM changes GROUP BY ALL)"""}


@query("C6_F17_language_classes", "repo language percentage:d percent_text class role", """
SELECT repo, language, percentage, printf('%.2f%%', percentage) AS percent_text,
  CASE WHEN percentage >= 5 THEN 'major' ELSE 'minor' END AS class,
  CASE WHEN percentage < 5 THEN NULL WHEN language = 'JavaScript' THEN 'Core application logic'
    WHEN language = 'JSON' THEN 'Configuration and data' WHEN language = 'YAML' THEN 'Configuration files'
    WHEN language = 'CSS' THEN 'User interface styling' WHEN language = 'Python'
    THEN 'Scripts and utilities' WHEN language = 'Markdown' THEN 'Documentation'
    ELSE 'Supporting files' END AS role FROM dist""", "changes", extra=LANGUAGES)
def c6(t):
    return report.language_classes(files.language_distribution(t.changes))


@query("C6_minor_language_hint", "repo hint", """
SELECT repo, CASE WHEN h = '' THEN 'specialized tools, legacy code, or project infrastructure'
  ELSE h END AS hint FROM (
  SELECT repo, concat_ws(', ', CASE WHEN bool_or(language = 'Python') THEN 'build/deployment scripts' END,
    CASE WHEN bool_or(language = 'Markdown') THEN 'documentation' END) AS h
  FROM (SELECT repo, language, percentage - 10 AS percentage FROM dist)
  WHERE percentage < 5 GROUP BY repo)""", "changes", extra=LANGUAGES)
def c6_hint(t):
    # shares lowered by ten points: the languages of the test data are all above five percent
    dist = files.language_distribution(t.changes)
    return report.minor_language_hint(dist.withColumn("percentage", F.col("percentage") - 10))


@query("A34_U1_table_counts", "repo table_name rows:l", """
SELECT repo, 'commits' AS table_name, count(*) AS rows FROM commits GROUP BY repo
UNION ALL SELECT repo, 'file_changes', count(*) FROM changes GROUP BY repo
UNION ALL SELECT repo, 'contributors', count(DISTINCT author_email) FROM commits GROUP BY repo
UNION ALL SELECT repo, 'branches', count(*) FROM branches GROUP BY repo
UNION ALL SELECT repo, 'tags', count(*) FROM tags GROUP BY repo""", "commits", "changes", "branches",
       "tags")
def a34(t):
    return report.table_counts({
        "commits": t.commits, "file_changes": t.changes, "branches": t.branches, "tags": t.tags,
        "contributors": contributors.contributors_from_commits(t.commits)})


WALK = {"walk": """SELECT repo, last_commit_hash AS hash, 0 AS back FROM branches WHERE branch_name = 'main'
    UNION ALL SELECT e.repo, e.parent, back + 1 FROM walk w
    JOIN edges e ON e.repo = w.repo AND e.child = w.hash AND e.place = 0"""}


def _main_heads(t):
    return t.branches.filter(F.col("branch_name") == "main").select("repo", F.col("last_commit_hash").alias("hash"))


@query("K1_S7_first_parent_head_files", "repo filepath", """
    SELECT repo, filepath FROM (SELECT c.repo, c.filepath, back,
        max(CASE WHEN change_type = 'D' THEN 0 ELSE 1 END) AS open
      FROM changes c JOIN walk w ON c.repo = w.repo AND c.commit_hash = w.hash GROUP BY ALL)
    GROUP BY repo, filepath HAVING arg_min(open, back) = 1""", "branches", "edges", "changes", extra=WALK)
def first_parent_head_files(t):
    order = lifetimes.first_parent_sequence(t.commits_with_parents, _main_heads(t))
    return lifetimes.head_files(lifetimes.file_lifetimes(t.changes, order))


@query("S15_K8_branch_commits", "repo hash", """SELECT repo, hash FROM reach""", "branches", "edges",
       extra={"reach": """SELECT repo, last_commit_hash AS hash FROM branches WHERE branch_name = 'main'
    UNION SELECT e.repo, e.parent FROM reach r JOIN edges e ON e.repo = r.repo AND e.child = r.hash"""})
def branch_commits(t):
    whole = History(commits=t.commits_with_parents, branches=t.branches)
    return branch_history(whole, "main").commits.select("repo", "hash")

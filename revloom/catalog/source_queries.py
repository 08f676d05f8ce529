"""Sources and sinks: each query writes what it reads into the shared scratch folder first."""

from pyspark.sql import functions as F

from revloom.catalog import dump_fixture
from revloom.catalog.commit_queries import BUSY
from revloom.catalog.file_queries import LANG_SQL
from revloom.catalog.registry import query
from revloom.operators import ancestry, commits, contributors, report
from revloom.operators.persistence import persistence_metrics
from revloom.plans import analyses
from revloom.plans.runtime import scratch_path, settle
from revloom.sources import documents, dumps, sinks, store, tables, wide_log

PARENTS = {"par": """SELECT repo, child, string_agg(parent, ' ' ORDER BY place) AS parents
  FROM edges GROUP BY repo, child"""}


@query("S1_commit_log_scan", "repo hash author_name author_email date:t message parents", """
SELECT c.repo, c.hash, author_name, author_email, date, message, coalesce(p.parents, '') AS parents
FROM commits c LEFT JOIN par p ON c.repo = p.repo AND c.hash = p.child""", "commits", "edges",
       extra=PARENTS)
def s1(t):
    root = dump_fixture.write_log(t, ("log",))
    return dumps.commits_from_log(dumps.read_log(t.spark, root)).withColumn(
        "parents", F.array_join("parents", " "))


@query("S1_wide_log_scan", "repo hash author_name author_email author_date:t committer_name committer_email date:t subject "
       "message parents files_changed:l insertions:l deletions:l lines_changed:l is_merge:b message_length:l", """
SELECT *, insertions + deletions AS lines_changed, length(subject) AS message_length FROM (
  SELECT c.repo, c.hash, author_name || ' | team' AS author_name, author_email, c.date - INTERVAL 1 DAY AS author_date,
    'Builder' AS committer_name, 'b@x.org' AS committer_email, c.date, message || ' | done' AS subject,
    message || ' | done' || chr(10) || chr(10) || 'see' || chr(10) || quote || chr(10) || '1' || chr(9) || '2' || chr(9)
      || 'counted' || chr(10) || chr(10) || quote AS message,
    coalesce(parents, '') AS parents, coalesce(k, 0) AS files_changed, coalesce(i, 0) AS insertions,
    coalesce(d, 0) AS deletions, coalesce(parents, '') LIKE '% %' AS is_merge
  FROM commits c LEFT JOIN par p ON p.repo = c.repo AND p.child = c.hash
  LEFT JOIN (SELECT repo, commit_hash, count(*) AS k,
      sum(CASE WHEN filepath LIKE '%.png' THEN 0 ELSE insertions END) AS i,
      sum(CASE WHEN filepath LIKE '%.png' THEN 0 ELSE deletions END) AS d FROM changes GROUP BY ALL) n
    ON n.repo = c.repo AND n.commit_hash = c.hash
  JOIN (SELECT f.repo, f.hash, coalesce(q.header, 'none') || '|x' AS quote FROM commits f
      LEFT JOIN edges e ON e.repo = f.repo AND e.child = f.hash AND e.place = 0
      LEFT JOIN heads q ON q.repo = e.repo AND q.hash = e.parent) x ON x.repo = c.repo AND x.hash = c.hash)""",
       "commits", "edges", "changes", extra={**PARENTS, "heads": """
  SELECT c.repo, c.hash, concat_ws('|', lpad(c.hash, 40, '0'), author_name || ' | team', author_email,
    strftime(c.date - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ'), 'Builder', 'b@x.org', strftime(c.date, '%Y-%m-%dT%H:%M:%SZ'),
    message || ' | done', coalesce(up, '')) AS header
  FROM commits c LEFT JOIN (SELECT repo, child, string_agg(lpad(parent, 40, '0'), ' ' ORDER BY place) AS up FROM edges
    GROUP BY repo, child) e ON e.repo = c.repo AND e.child = c.hash"""})
def s1_wide(t):
    found = wide_log.commits_from_wide(wide_log.read_wide_records(t.spark, dump_fixture.write_wide_log(t)))
    short = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    return found.withColumns({"hash": short("hash"), "parents": F.array_join(F.transform("parents", short), " ")})


@query("S1_pipe_log_scan", "repo hash author_name author_email date:t message", """
SELECT repo, hash, author_name, author_email, date, message || ' | more' AS message FROM commits""",
       "commits")
def s1_pipe(t):
    return dumps.read_pipe_log(t.spark, dump_fixture.write_pipe_log(t))[0]


@query("S2_pipe_name_status_scan", "repo commit_hash filepath change_type old_path", """
SELECT repo, commit_hash, filepath, change_type,
  CASE WHEN change_type = 'R' THEN 'old/' || filepath END AS old_path FROM changes""", "changes")
def s2_pipe(t):
    return dumps.read_pipe_log(t.spark, dump_fixture.write_pipe_log(t))[1]


@query("S2_P11_name_status_scan", "repo commit_hash filepath change_type old_path", """
SELECT repo, commit_hash, filepath, change_type,
  CASE WHEN change_type = 'R' THEN 'old/' || filepath END AS old_path FROM changes""", "changes")
def s2(t):
    root = dump_fixture.write_log(t, ("log",))
    return dumps.changes_from_log(dumps.read_log(t.spark, root))


@query("S3_P12_numstat_scan", "repo commit_hash filepath insertions:l deletions:l is_binary_change:b", """
SELECT repo, commit_hash, filepath,
  CASE WHEN filepath LIKE '%.png' THEN 0 ELSE insertions END AS insertions,
  CASE WHEN filepath LIKE '%.png' THEN 0 ELSE deletions END AS deletions,
  filepath LIKE '%.png' AS is_binary_change FROM changes""", "changes")
def s3(t):
    return dumps.read_numstat(t.spark, dump_fixture.write_log(t, ("numstat",)))


@query("J4_P13_changes_with_line_counts", "repo commit_hash filepath change_type insertions:l "
       "deletions:l total_churn:l", """
SELECT c.repo, c.commit_hash, c.filepath, c.change_type, n.insertions, n.deletions,
  n.insertions + n.deletions AS total_churn
FROM changes c JOIN (
  SELECT repo, commit_hash, filepath,
    CASE WHEN filepath LIKE '%.png' THEN 0 ELSE x.i END AS insertions,
    CASE WHEN filepath LIKE '%.png' THEN 0 ELSE x.d END AS deletions
  FROM (SELECT repo, commit_hash, filepath, max({'d': deletions, 'i': insertions}) AS x
        FROM changes GROUP BY ALL)) n
ON c.repo = n.repo AND c.commit_hash = n.commit_hash AND c.filepath = n.filepath""", "changes")
def j4(t):
    return tables.read_history(t.spark, dump_fixture.write_log(t)).file_changes


@query("S4_tree_listing_scan", "repo commit_hash filepath mode size:l", """
SELECT repo, 'head' AS commit_hash, filepath, '100644' AS mode, length(filepath) AS size FROM head""",
       "head")
def s4(t):
    return dumps.read_tree(t.spark, dump_fixture.write_tree(t))


@query("S5_U5_refs_scan", "repo branch_name full_name is_current:b is_remote:b last_commit_hash "
       "last_commit_date last_commit_author upstream", """
SELECT repo, branch_name, full_name, is_current, is_remote, last_commit_hash,
  '2001-01-01' AS last_commit_date, 'someone' AS last_commit_author, '' AS upstream FROM branches""",
       "branches")
def s5(t):
    return dumps.read_refs(t.spark, dump_fixture.write_refs(t))


@query("S6_tags_scan", "repo tag_name commit_hash tagger_date tagger_name subject is_annotated:b", """
SELECT repo, tag_name, commit_hash, tagger_date,
  CASE WHEN tagger_date = '' THEN '' ELSE 'someone' END AS tagger_name,
  CASE WHEN tagger_date = '' THEN '' ELSE 'release' END AS subject,
  tagger_date <> '' AS is_annotated FROM tags""", "tags")
def s6(t):
    return dumps.read_tags(t.spark, dump_fixture.write_refs(t))


def _history(t):
    # settled: all three tables read the changes
    changes = settle(t.changes)
    wide = settle(commits.export_commits(t.commits_with_parents, changes))
    return tables.History(
        commits=persistence_metrics(wide), file_changes=changes,
        contributors=contributors.contributor_export(t.commits, changes))


def _documents(t):
    path = scratch_path(t.spark, "documents")
    # settled: each table is counted before it is packed
    form = {name: settle(table) for name, table in documents.export_form(_history(t)).items()}
    documents.to_documents(form, 2000).select("document").write.text(path, compression="gzip")
    return documents.read_documents(t.spark, path, one_per_line=True)


@query("S8_P5_document_commits", "repo hash author_name author_email date:t message parents "
       "lines_changed:l age_days:l asi:d", """
SELECT c.repo, c.hash, author_name, author_email, c.date, message, coalesce(p.parents, '') AS parents,
  lines_changed, age_days, asi
FROM commits c JOIN metrics m ON c.repo = m.repo AND c.hash = m.hash
LEFT JOIN par p ON c.repo = p.repo AND c.hash = p.child""", "commits", "metrics", "edges",
       extra=PARENTS)
def s8_commits(t):
    read = documents.history_from_documents(_documents(t)).commits
    return read.withColumn("parents", F.array_join("parents", " "))


@query("S8_S12_document_changes", "repo commit_hash filepath change_type date:t", """
SELECT c.repo, commit_hash, filepath, change_type, date
FROM changes c JOIN ord o ON c.repo = o.repo AND c.commit_hash = o.hash""", "changes", "ord")
def s8_changes(t):
    return documents.history_from_documents(_documents(t)).file_changes


@query("S9_S10_table_store", "table_name repo commit_hash filepath change_type insertions:l deletions:l "
       "total_churn:l author_name author_email date:t message", """
SELECT 'file_changes' AS table_name, repo, commit_hash, filepath, change_type, insertions, deletions, total_churn,
  NULL AS author_name, NULL AS author_email, CAST(NULL AS TIMESTAMP) AS date, NULL AS message FROM changes
UNION ALL SELECT 'file_presence', repo, commit_hash, filepath, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM changes
UNION ALL SELECT 'commits', repo, hash, NULL, NULL, NULL, NULL, NULL, author_name, author_email, date, message
FROM commits""", "changes", "commits")
def s9(t):
    root = scratch_path(t.spark, "store")
    build = lambda: tables.History(
        commits=t.commits, file_changes=t.changes,
        file_presence=t.changes.select("repo", "commit_hash", "filepath"))
    tables.stored_or_built(t.spark, root, build)
    # the second time nothing is built
    stored = tables.stored_or_built(t.spark, root, None)
    parts = {"file_changes": stored.file_changes, "file_presence": stored.file_presence,
             "commits": stored.commits.withColumnRenamed("hash", "commit_hash")}
    named = [part.withColumn("table_name", F.lit(name)) for name, part in parts.items()]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(
        named[2], allowMissingColumns=True)


@query("S11_csv_sink", "repo hash architectural_metrics_age_days:l architectural_metrics_asi:d", """
SELECT repo, hash, age_days AS architectural_metrics_age_days, asi AS architectural_metrics_asi
FROM metrics""", "metrics")
def s11(t):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t.metrics.select("repo", "hash", "architectural_metrics"), path)
    return t.spark.read.option("header", True).csv(path)


PATTERNS = {"patterns": """SELECT t.repo, day AS most_active_day, day_n AS most_active_day_count,
  hour AS most_active_hour, hour_n AS most_active_hour_count, merge_commit_percentage, avg_message_length,
  monthly_commit_trend
FROM (SELECT c.repo, round(count(e.child) * 100.0::DOUBLE / count(*), 2) AS merge_commit_percentage,
        round(avg(length(message)), 2) AS avg_message_length
      FROM commits c LEFT JOIN (SELECT repo, child FROM edges WHERE place = 1) e
        ON c.repo = e.repo AND c.hash = e.child GROUP BY c.repo) t
JOIN busy USING (repo) JOIN busy_hour USING (repo)
JOIN (SELECT repo, '{' || string_agg('"' || m || '":' || n, ',' ORDER BY m) || '}' AS monthly_commit_trend
      FROM (SELECT repo, strftime(date, '%Y-%m') AS m, count(*) AS n FROM ord GROUP BY ALL)
      GROUP BY repo) USING (repo)"""}
PATTERN_METRICS = ("most_active_day", "most_active_day_count", "most_active_hour", "most_active_hour_count",
                   "merge_commit_percentage", "avg_message_length", "monthly_commit_trend")


@query("S11_pattern_rows", "repo metric value", " UNION ALL ".join(
    f"SELECT repo, '{m}' AS metric, CAST({m} AS VARCHAR) AS value FROM patterns" for m in PATTERN_METRICS),
       "commits", "edges", extra=BUSY | PATTERNS)
def s11_patterns(t):
    return sinks.metric_rows(commits.commit_patterns(t.commits_with_parents))


@query("S12_json_sink", "repo hash author_name author_email date:t message", """
SELECT repo, hash, author_name, author_email, date, message FROM commits""", "commits")
def s12(t):
    path = scratch_path(t.spark, "json")
    sinks.write_json(t.commits, path)
    return t.spark.read.schema("repo string, hash string, author_name string, author_email string, "
                               "date timestamp, message string").json(path)


@query("S13_sql_access", "repo author_name n:l churn:l", """
SELECT c.repo, author_name, count(*) AS n, sum(total_churn) AS churn
FROM commits c JOIN changes f ON c.repo = f.repo AND c.hash = f.commit_hash GROUP BY ALL""",
       "commits", "changes")
def s13(t):
    tables.History(commits=t.commits, file_changes=t.changes).register_views("history_")
    return t.spark.sql("""SELECT c.repo, author_name, count(*) AS n, sum(total_churn) AS churn
        FROM history_commits c JOIN history_file_changes f
        ON c.repo = f.repo AND c.hash = f.commit_hash GROUP BY c.repo, author_name""")


@query("S15_branch_choice", "repo branch", """
SELECT repo, coalesce(arg_min(branch_name, CASE branch_name WHEN 'u12' THEN 1 WHEN 'u7' THEN 2
    WHEN 'main' THEN 3 END), min(branch_name) FILTER (is_current)) AS branch
FROM branches GROUP BY repo""", "branches")
def s15(t):
    return ancestry.choose_branch(t.branches, "u12", ("u7", "main"))


@query("S14_S16_limited_history", "repo table_name rows:l", """
SELECT repo, 'commits' AS table_name, count(*) AS rows FROM kept GROUP BY repo
UNION ALL SELECT c.repo, 'file_changes', count(*) FROM changes c SEMI JOIN kept k
  ON c.repo = k.repo AND c.commit_hash = k.hash GROUP BY c.repo
UNION ALL SELECT repo, 'contributors', count(DISTINCT o_custkey) FROM kept GROUP BY repo
UNION ALL SELECT repo, 'commit_patterns', 1 FROM kept GROUP BY repo""", "ord", "changes",
       extra={"kept": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo
         ORDER BY date DESC, hash) AS r FROM ord) WHERE r <= 500"""})
def s16(t):
    base = tables.History(commits=t.commits_with_parents, file_changes=t.changes)
    built = tables.build_history(base, newest=500).tables()
    built.pop("language_statistics")
    return report.table_counts(built)


@query("S16_limited_tables", "table_name repo key n:l lines:l", f"""
SELECT 'commits' AS table_name, k.repo, k.hash AS key, count(c.filepath) AS n, coalesce(sum(total_churn), 0) AS lines
FROM kept k LEFT JOIN changes c ON c.repo = k.repo AND c.commit_hash = k.hash GROUP BY k.repo, k.hash
UNION ALL SELECT 'contributors', k.repo, 'c' || o_custkey || '@example.com', count(DISTINCT k.hash),
  coalesce(sum(total_churn), 0)
FROM kept k LEFT JOIN changes c ON c.repo = k.repo AND c.commit_hash = k.hash GROUP BY k.repo, o_custkey
UNION ALL SELECT 'file_changes', c.repo, commit_hash || '/' || filepath, insertions, total_churn FROM changes c
  SEMI JOIN kept k ON c.repo = k.repo AND c.commit_hash = k.hash
UNION ALL SELECT 'language_statistics', repo, {LANG_SQL}, count(*), NULL FROM (
  SELECT repo, filepath FROM (SELECT c.repo, filepath, date, hash,
      max(CASE WHEN change_type = 'D' THEN 0 ELSE 1 END) AS open
    FROM changes c JOIN kept k ON c.repo = k.repo AND c.commit_hash = k.hash GROUP BY ALL)
  GROUP BY repo, filepath HAVING arg_max(open, (date, hash)) = 1)
WHERE NOT filepath LIKE '%.png' GROUP BY ALL""", "ord", "changes",
       extra={"kept": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo
         ORDER BY date DESC, hash) AS r FROM ord) WHERE r <= 500"""})
def s16_tables(t):
    """The rows of an extraction that is limited to the newest commits, and not only their number."""
    built = tables.build_history(tables.History(commits=t.commits_with_parents, file_changes=t.changes), newest=500)
    key = F.concat_ws("/", "commit_hash", "filepath")
    parts = {"commits": (built.commits, F.col("hash"), "files_changed", "lines_changed"),
             "contributors": (built.contributors, F.col("author_email"), "commit_count", "total_lines_changed"),
             "file_changes": (built.file_changes, key, "insertions", "total_churn"),
             "language_statistics": (built.language_statistics, F.col("language"), "file_count", None)}
    rows = [table.select(F.lit(name).alias("table_name"), "repo", key.alias("key"), F.col(n).cast("long").alias("n"),
                         (F.col(lines) if lines else F.lit(None)).cast("long").alias("lines"))
            for name, (table, key, n, lines) in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("X1_U3_analyses", "analysis table_name repo rows:l", """
SELECT 'commits' AS analysis, 'years' AS table_name, repo, count(DISTINCT year(date)) AS rows
FROM ord GROUP BY repo
UNION ALL SELECT 'hotspots', 'heat_counts', repo, count(DISTINCT CASE WHEN n <= p50 THEN 1
  WHEN n <= p80 THEN 2 WHEN n <= p95 THEN 3 ELSE 4 END) FROM kept JOIN (
    SELECT repo, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.8) AS p80,
      quantile_cont(n, 0.95) AS p95 FROM kept GROUP BY repo) q USING (repo) GROUP BY repo
UNION ALL SELECT 'unknown', 'unknown analysis', '', 0
UNION ALL SELECT 'nothing', 'missing tables: tags', '', 0""", "ord", "changes",
       extra={"kept": """SELECT repo, filepath, count(*) AS n FROM changes
         WHERE NOT regexp_matches(filepath, '\\.png$') GROUP BY ALL HAVING count(*) >= 2"""})
def x1(t):
    analyses.REGISTRY.setdefault("nothing", analyses.Analysis(
        "nothing", frozenset({"tags"}), lambda history, config: {}))
    config = analyses.AnalysisConfig(modules=("commits", "hotspots", "unknown", "nothing"),
                                     exclude_paths=(r"\.png$",))
    history = tables.History(commits=t.orders, file_changes=t.changes)
    outcome = analyses.run(history, config)
    parts = [outcome.tables[a][b].groupBy("repo").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(a).alias("analysis"), F.lit(b).alias("table_name"), "repo", "rows")
        for a, b in (("commits", "years"), ("hotspots", "heat_counts"))]
    skipped = outcome.status(t.spark).filter(F.col("status") == "skipped").select(
        "analysis", F.col("reason").alias("table_name"), F.lit("").alias("repo"),
        F.lit(0).alias("rows"))
    return parts[0].unionByName(parts[1]).unionByName(skipped)


@query("X1_run_outcomes", "analysis table_name status rows:l", """
SELECT analysis, table_name, 'done' AS status, rows FROM (
  SELECT 'commits' AS analysis, 'years' AS table_name, count(DISTINCT (repo, year(date))) AS rows FROM ord
  UNION ALL SELECT 'contributors', 'overview', count(DISTINCT repo) FROM ord
  UNION ALL SELECT 'files', 'file_extension_counts', count(DISTINCT (repo, regexp_extract(filepath, '(\\.[a-z]*)?$', 0)))
    FROM kept
  UNION ALL SELECT 'hotspots', 'top_files', sum(least(n, 20)) FROM (SELECT count(*) AS n FROM kept GROUP BY repo)
  UNION ALL SELECT 'architectural', 'summary', count(DISTINCT repo) FROM ord
  UNION ALL SELECT 'activity', 'peaks', count(DISTINCT repo) FROM ord)
UNION ALL SELECT 'broken', NULL, 'failed', NULL UNION ALL SELECT 'unknown', NULL, 'skipped', NULL""", "ord", "changes",
       extra={"kept": "SELECT repo, filepath, count(*) AS n FROM changes GROUP BY ALL HAVING count(*) >= 2"})
def x1_outcomes(t):
    """All six analyses written; one table of each compared by the rows counted while writing, beside one that fails
    when it is computed."""
    # a table that can be declared but not computed
    analyses.REGISTRY.setdefault("broken", analyses.Analysis("broken", frozenset({"commits"}), lambda history, config: {
        "first": history.commits.select("repo"),
        "second": history.commits.select(F.raise_error(F.concat(F.lit("no such "), "repo")).cast("string").alias("x"))}))
    config = analyses.AnalysisConfig(modules=("commits", "contributors", "broken", "files", "hotspots", "architectural",
                                              "activity", "unknown"))
    wide = commits.export_commits(t.commits_with_parents, t.changes)
    written = analyses.run_and_write(t.spark, tables.History(commits=settle(wide), file_changes=t.changes),
                                     scratch_path(t.spark, "analyses"), config)
    shown = ("years", "overview", "file_extension_counts", "top_files", "summary", "peaks")
    wanted = dict(zip(("commits", "contributors", "files", "hotspots", "architectural", "activity"), shown))
    status = written.status(t.spark)
    one_each = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    return status.filter(F.col("table_name").isNull() | (F.col("table_name") == one_each[F.col("analysis")]))


@query("S9_S10_refreshed_store", "table_name repo id filepath change_type date:t", """
SELECT 'commits' AS table_name, repo, hash AS id, NULL AS filepath, NULL AS change_type, date FROM kept
UNION ALL SELECT 'file_changes', c.repo, commit_hash, filepath, change_type, NULL FROM changes c
  SEMI JOIN kept k ON k.repo = c.repo AND k.hash = c.commit_hash""", "ord", "changes",
       extra={"kept": """SELECT repo, hash, date FROM ord
         WHERE repo IN ('core', 'lib4') OR (date < TIMESTAMP '1996-01-01' AND repo <> 'lib7')"""})
def s9_refreshed(t):
    """A store as of 1996, renewed where a repository has changed since; one repository is given up."""
    root = scratch_path(t.spark, "versions")
    early = t.commits.filter(F.col("date") < "1996-01-01")
    mark = t.orders.select("repo").distinct().withColumn("fingerprint", F.lit("1996"))
    store.refresh(t.spark, root, mark, lambda changed: tables.History(commits=early, file_changes=t.changes.join(
        early.select("repo", F.col("hash").alias("commit_hash")), ["repo", "commit_hash"], "left_semi")))
    later = mark.filter("repo <> 'lib7'").withColumn("fingerprint", F.when(
        F.col("repo").isin("core", "lib4"), "later").otherwise(F.col("fingerprint")))
    store.refresh(t.spark, root, later, lambda changed: tables.History(commits=t.commits, file_changes=t.changes))
    found = store.read_store(t.spark, root)
    return found.commits.select(F.lit("commits").alias("table_name"), "repo", F.col("hash").alias("id"), "date").unionByName(
        found.file_changes.select(F.lit("file_changes").alias("table_name"), "repo", F.col("commit_hash").alias("id"),
                                  "filepath", "change_type"), allowMissingColumns=True)

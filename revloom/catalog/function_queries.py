"""Functions, cleaning and filters over paths, urls, events and change rows."""

from pyspark.sql import functions as F

from revloom.catalog.adapters import AS_OF
from revloom.catalog.registry import query
from revloom.functions import paths, scalars, text
from revloom.operators import clean, files

# repository paths, page urls and document paths; one row per path
PATHS = {"paths": """SELECT DISTINCT filepath AS p FROM changes UNION SELECT url FROM pages
  UNION SELECT filepath FROM contents""",
         "named": """SELECT p, regexp_extract(p, '([^/]*)$', 1) AS n,
  regexp_replace(regexp_extract(p, '([^/]*)$', 1), '^\\.+', '') AS u FROM paths""",
         "suffixed": """SELECT *, lower(regexp_extract(u, '(?s)^.+(\\.[^.]+)$', 1)) AS sfx,
  lower(regexp_extract(u, '(?s)^[^.]+(\\..*[^.])$', 1)) AS sfxs FROM named"""}


def _paths(t):
    return (t.changes.select(F.col("filepath").alias("p")).union(t.read("pages").select("url"))
            .union(t.contents.select("filepath")).distinct())


def _path_query(key, columns, sql):
    return query(key, columns, sql, "changes", "contents", extra=PATHS)


@_path_query("F1_F2_F3_names_and_suffixes", "p name suffix suffixes stem", """
SELECT p, n AS name, sfx AS suffix, CASE WHEN sfxs = '' THEN 'no_ext' ELSE sfxs END AS suffixes,
  substr(n, 1, length(n) - length(sfx)) AS stem FROM suffixed""")
def f123(t):
    return _paths(t).select("p", paths.path_name("p").alias("name"),
                            paths.path_suffix("p").alias("suffix"),
                            paths.path_suffixes("p").alias("suffixes"),
                            paths.path_stem("p").alias("stem"))


@_path_query("F4_P4_depths_and_directories", "p path_depth:l directory_depth:l directory top_level_dir "
             "prefix1 prefix2", """
SELECT p, len(string_split(p, '/')) AS path_depth, len(string_split(p, '/')) - 1 AS directory_depth,
  CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE 'root' END AS directory,
  split_part(p, '/', 1) AS top_level_dir,
  CASE WHEN len(string_split(p, '/')) <= 1 THEN '.' ELSE split_part(p, '/', 1) END AS prefix1,
  CASE WHEN len(string_split(p, '/')) <= 2 THEN '.'
    ELSE array_to_string(string_split(p, '/')[1:2], '/') END AS prefix2 FROM paths""")
def f4(t):
    return _paths(t).select(
        "p", paths.path_depth("p").alias("path_depth"),
        paths.directory_depth("p").alias("directory_depth"), paths.path_dir("p").alias("directory"),
        paths.top_level_dir("p").alias("top_level_dir"), paths.path_prefix("p", 1).alias("prefix1"),
        paths.path_prefix("p", 2).alias("prefix2"))


@_path_query("F5_F6_language_and_binary", "p language is_binary:b", """
SELECT p, CASE WHEN contains(lower(n), 'dockerfile') THEN 'Dockerfile'
  WHEN contains(lower(n), 'makefile') THEN 'Makefile' WHEN sfx = '.py' THEN 'Python'
  WHEN sfx = '.js' THEN 'JavaScript' WHEN sfx = '.md' THEN 'Markdown' WHEN sfx = '.json' THEN 'JSON'
  WHEN sfx = '.yaml' THEN 'YAML' WHEN sfx = '.css' THEN 'CSS' WHEN sfx = '.html' THEN 'HTML'
  ELSE 'Other' END AS language,
  sfx IN ('.png', '.jpg', '.pdf', '.gif', '.zip') AS is_binary FROM suffixed""")
def f56(t):
    return _paths(t).select("p", paths.language_of("p").alias("language"),
                            paths.is_binary_path("p").alias("is_binary"))


@_path_query("F7_F8_F9_file_kinds", "p is_test:b is_config:b is_docs:b topic", """
SELECT p, CASE WHEN NOT contains(p, '/') THEN starts_with(lower(p), 'test_')
    OR ends_with(lower(p), '_test.py') ELSE contains(lower(p), 'test') END AS is_test,
  sfx IN ('.json', '.yaml', '.yml', '.xml', '.ini', '.toml', '.cfg') OR regexp_matches(
    substr(lower(n), 1, length(n) - length(sfx)),
    'config|configuration|settings|dockerfile|makefile') AS is_config,
  sfx IN ('.md', '.rst', '.txt', '.docx')
    OR list_has_any(string_split(lower(p), '/'), ['doc', 'docs', 'documentation']) AS is_docs,
  CASE WHEN regexp_matches(lower(p), 'package\\.json|package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock')
      THEN 'Package Management'
    WHEN regexp_matches(lower(p), '\\.js|\\.ts|\\.py') AND NOT contains(lower(p), 'test')
      THEN 'Core Logic'
    WHEN regexp_matches(lower(p), '\\.yml|\\.yaml|\\.json|dockerfile|makefile') THEN 'Configuration'
    WHEN regexp_matches(lower(p), '\\.css|\\.html|\\.vue|\\.jsx|\\.tsx') THEN 'UI/Frontend'
    WHEN regexp_matches(lower(p), 'readme|changelog|\\.md') THEN 'Documentation' ELSE 'Other' END
    AS topic FROM suffixed""")
def f789(t):
    return _paths(t).select("p", paths.is_test_file("p").alias("is_test"),
                            paths.is_config_file("p").alias("is_config"),
                            paths.is_documentation("p").alias("is_docs"),
                            paths.hotspot_topic("p").alias("topic"))


@query("F10_F11_age_and_format", "l_orderkey:l l_partkey:l age:l shipped", """
SELECT l_orderkey, l_partkey, CAST(floor(date_diff('microsecond', o_orderdate
    + to_seconds((o_orderkey * 7919) % 86400), l_shipdate) / 86400000000.0::DOUBLE) AS BIGINT) AS age,
  strftime(l_shipdate, '%d/%m/%Y') AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def f10(t):
    made = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "date")
    rows = t.read("lineitem").join(made, "l_orderkey")
    shipped = F.col("l_shipdate").cast("timestamp")
    return rows.select("l_orderkey", "l_partkey", scalars.age_days("date", shipped).alias("age"),
                       scalars.format_date(shipped, "dd/MM/yyyy").alias("shipped"))


@query("F12_human_size", "doc_id:l size", """
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1fB', b)
  WHEN b < 1048576 THEN printf('%.1fKB', b / 1024)
  WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576)
  WHEN b < 1099511627776 THEN printf('%.1fGB', b / 1073741824)
  ELSE printf('%.1fTB', b / 1099511627776) END AS size
FROM (SELECT doc_id, (CAST(n_chars AS BIGINT) * (CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 37
  WHEN 2 THEN 100003 WHEN 3 THEN 1000003 ELSE 5000000029 END))::DOUBLE AS b FROM documents)""")
def f12(t):
    scale = F.element_at(F.array(*[F.lit(x).cast("long") for x in
                                   (1, 37, 100003, 1000003, 5000000029)]),
                         (F.col("doc_id") % 5 + 1).cast("int"))
    return t.read("documents").select(
        "doc_id", scalars.human_size(F.col("n_chars") * scale).alias("size"))


@query("F16_rounding", "l_orderkey:l l_partkey:l l_linenumber:l one:d two:d four:d", """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 1)
    AS DOUBLE) AS one, l_extendedprice AS two, l_discount AS four FROM lineitem""")
def f16(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round("l_extendedprice", 1).alias("one"),
        F.round("l_extendedprice", 2).alias("two"), F.round("l_discount", 4).alias("four"))


@query("P1_conform_names", "repo commit_hash author_name", """
SELECT repo, hash AS commit_hash, author_name FROM commits""", "commits")
def p1(t):
    return clean.conform(t.commits, clean.COMMIT_ALIASES)


@query("P2_lenient_dates", "event_id:l parsed:t", """
SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS parsed FROM events
WHERE event_type <> 'error'""")
def p2(t):
    stamp = F.when(F.col("event_type") == "error", "no date").otherwise(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return clean.parse_dates(t.read("events").select("event_id", stamp.alias("parsed")), ["parsed"], "parsed")


@query("P3_calendar_columns", "hash year:l month day_of_week hour:l", """
SELECT hash, year(date) AS year, CAST(date_trunc('month', date) AS DATE) AS month,
  dayname(date) AS day_of_week, hour(date) AS hour FROM ev""", "ev")
def p3(t):
    return clean.with_calendar(t.events)


@query("P4_path_columns", "repo commit_hash filepath file_extension filename directory path_depth:l "
       "top_level_dir", """
SELECT repo, commit_hash, filepath, CASE WHEN filepath LIKE '%.%' THEN '.' || split_part(filepath, '.', 2)
    ELSE 'no_ext' END AS file_extension, split_part(filepath, '/', 3) AS filename,
  split_part(filepath, '/', 1) || '/' || split_part(filepath, '/', 2) AS directory, 3 AS path_depth,
  split_part(filepath, '/', 1) AS top_level_dir FROM changes""", "changes")
def p4(t):
    return clean.with_path_columns(t.changes)


BROKEN = """SELECT repo, commit_hash, CASE deletions WHEN 7 THEN NULL WHEN 6 THEN '' ELSE filepath END
  AS filepath FROM changes"""


def _broken(t):
    path = F.when(F.col("deletions") == 7, None).when(F.col("deletions") == 6, "").otherwise(
        F.col("filepath"))
    return t.changes.withColumn("filepath", path)


@query("P6_drop_invalid_rows", "repo commit_hash filepath", f"""
SELECT * FROM ({BROKEN}) WHERE filepath IS NOT NULL AND filepath <> ''""", "changes")
def p6(t):
    dated = _broken(t).withColumn("date", F.lit(AS_OF).cast("timestamp"))
    return clean.drop_invalid_changes(dated)


@query("P7_date_range", "repo hash date:t", """
SELECT repo, hash, date FROM ord
WHERE date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30 12:00:00'""", "ord")
def p7(t):
    return clean.filter_dates(t.orders, "1997-01-01, 1998-06-30T12:00:00")


@query("P8_exclude_paths", "repo commit_hash filepath", f"""
SELECT * FROM ({BROKEN}) WHERE filepath IS NULL
  OR NOT (regexp_matches(filepath, '\\.png$') OR regexp_matches(filepath, '^economy/'))""", "changes")
def p8(t):
    return clean.exclude_paths(_broken(t), [r"\.png$", "^economy/"])


@query("P9_J5_frequent_files", "repo commit_hash filepath", """
SELECT c.repo, commit_hash, c.filepath FROM changes c SEMI JOIN (
  SELECT repo, filepath FROM changes GROUP BY ALL HAVING count(*) >= 8) f
  ON c.repo = f.repo AND c.filepath = f.filepath""", "changes")
def p9(t):
    return clean.frequent_files(t.changes, 8)


@query("P10_repair_text", "doc_id:l text", """
SELECT doc_id, text || chr(65533) || '!' AS text FROM documents""")
def p10(t):
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF21"))).cast("string")
    return clean.repair_text(t.read("documents").select("doc_id", broken.alias("text")))


@query("P11_P12_P13_normalised_changes", "repo commit_hash filepath change_type total_churn:l", """
SELECT repo, commit_hash, CASE WHEN change_type = 'R' AND insertions % 2 = 0
    THEN split_part(filepath, '/', 3) ELSE filepath END AS filepath, change_type,
  insertions + deletions AS total_churn FROM changes WHERE deletions <> 7""", "changes")
def p11(t):
    # statuses as R100 or T, renames in both notations
    moved = F.when(F.col("insertions") % 2 == 0, F.concat(
        F.lit("old/path => "), paths.path_name("filepath"))).otherwise(
        F.regexp_replace("filepath", "^([^/]*)/", "{somewhere => $1}/"))
    raw = t.changes.select(
        "repo", "commit_hash", "insertions", "deletions",
        F.when(F.col("deletions") == 7, "T").when(F.col("change_type") == "R", "R100")
        .otherwise(F.col("change_type")).alias("status"),
        F.when(F.col("change_type") == "R", moved).otherwise(F.col("filepath")).alias("path"))
    return clean.normalise_changes(raw)


@query("P16_recency_filter", "repo hash date:t", f"""
SELECT repo, hash, date FROM ord WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY""", "ord")
def p16(t):
    return clean.recent(t.orders, AS_OF, 400)


@query("P17_suffix_filter", "repo commit_hash filepath", """
SELECT repo, commit_hash, filepath FROM changes
WHERE filepath LIKE '%.py' OR filepath LIKE '%.css'""", "changes")
def p17(t):
    return clean.with_suffix(t.changes, [".py", ".css"])


@query("J1_dated_changes", "repo commit_hash filepath date:t", """
SELECT c.repo, commit_hash, filepath, date FROM changes c
JOIN ord o ON c.repo = o.repo AND c.commit_hash = o.hash""", "changes", "ord")
def j1(t):
    return files.date_changes(t.changes, t.orders)


@query("F14_event_trend", "repo day events:l bar", """
SELECT repo, day, n AS events, repeat('█', CAST(floor(n::DOUBLE / max(n) OVER (PARTITION BY repo) * 50)
  AS BIGINT)) AS bar
FROM (SELECT repo, CAST(CAST(date AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ev GROUP BY ALL)""",
       "ev")
def f14(t):
    days = t.events.groupBy("repo", F.to_date("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("events"))
    top = days.groupBy("repo").agg(F.max("events").alias("_top"))
    return days.join(top, "repo").withColumn("bar", scalars.trend_bar("events", "_top"))


@query("F15_message_text", "repo hash subject message_length:l kind", """
SELECT repo, hash, split_part(message, ' ', 1) AS subject, length(message) AS message_length,
  CASE WHEN regexp_matches(message, '^(?:feat|fix)') THEN 'change' ELSE 'other' END AS kind
FROM commits""", "commits")
def f15(t):
    lines = F.replace("message", F.lit(" "), F.lit("\n"))
    return t.commits.select(
        "repo", "hash", text.subject_line(lines).alias("subject"),
        F.length("message").alias("message_length"),
        F.when(text.has_word("message", ("feat", "fix")), "change").otherwise("other").alias("kind"))

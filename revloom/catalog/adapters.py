"""History-shaped views of the given tables, in Spark and as SQL common table expressions.

Orders are commits, line items are file changes, parts are files, customers are authors. Repositories
come from the order key so that one of them ("core") holds three eighths of all rows.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from revloom.operators import commits as commit_ops, lifetimes
from revloom.operators.persistence import persistence_metrics
from revloom.plans.runtime import settle, size_partitions

AS_OF = "2001-09-01 00:00:00"
TEAMS = 64


def _repo(key: Column) -> Column:
    slot = key % 8
    return F.when(slot < 3, "core").otherwise(F.concat(F.lit("lib"), slot.cast("string")))


class Tables:
    """Lazy adapters over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # the files hold zone-less times; read and write them as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        size_partitions(spark, *(f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "events")))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with repo, hash and the time of the commit."""
        o = self.read("orders")
        seconds = F.make_dt_interval(secs=(F.col("o_orderkey") * 7919 % 86400).cast("decimal(18,6)"))
        return o.withColumns({
            "repo": _repo(F.col("o_orderkey")), "hash": F.col("o_orderkey").cast("string"),
            "date": (F.col("o_orderdate") + seconds).cast("timestamp")})

    @cached_property
    def commits(self) -> DataFrame:
        people = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
        what = F.lower("o_orderpriority")
        message = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("fix: resolve "), what))
                   .when(F.col("o_orderstatus") == "O", F.concat(F.lit("feat: add "), what))
                   .otherwise(F.concat(F.lit("refactor: tidy "), what)))
        email = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))
        return self.orders.join(people, "o_custkey").select(
            "repo", "hash", F.col("c_name").alias("author_name"), email.alias("author_email"),
            "date", message.alias("message"))

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem").withColumn("repo", _repo(F.col("l_orderkey")))

    @cached_property
    def part_paths(self) -> DataFrame:
        extensions = F.array(*map(F.lit, (".py", ".js", ".md", ".json", ".yaml", ".css", ".png", "")))
        name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey"))
        path = F.concat(F.lower("p_type"), F.lit("/"),
                        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), name,
                        F.element_at(extensions, F.col("p_size") % 8 + 1))
        return self.read("part").select(F.col("p_partkey").alias("l_partkey"),
                                        path.alias("filepath"))

    @cached_property
    def changes(self) -> DataFrame:
        kind = (F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M")
                .when(F.col("l_linestatus") == "F", "D").otherwise("R"))
        lines, churn = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
        return self.lineitem.join(self.part_paths, "l_partkey").select(
            "repo", F.col("l_orderkey").cast("string").alias("commit_hash"), "filepath",
            kind.alias("change_type"), lines.alias("insertions"), churn.alias("deletions"),
            (lines + churn).alias("total_churn"))

    @cached_property
    def edges(self) -> DataFrame:
        """Parents: the previous commit of the same author, and for every fifth one also the one before."""
        line = W.partitionBy("repo", "o_custkey").orderBy("o_orderdate", "o_orderkey")
        rows = self.orders.select(
            "repo", F.col("hash").alias("child"), F.lag("hash", 1).over(line).alias("_first"),
            F.when(F.col("o_orderkey") % 5 == 0, F.lag("hash", 2).over(line)).alias("_second"))
        parents = F.array(F.struct(F.lit(0).alias("place"), F.col("_first").alias("parent")),
                          F.struct(F.lit(1).alias("place"), F.col("_second").alias("parent")))
        return rows.select("repo", "child", F.inline(parents)).filter(F.col("parent").isNotNull())

    @cached_property
    def commits_with_parents(self) -> DataFrame:
        line = W.partitionBy("repo", "author_email").orderBy(F.to_date("date"),
                                                             F.col("hash").cast("long"))
        rows = self.commits.withColumns({
            "_first": F.lag("hash", 1).over(line),
            "_second": F.when(F.col("hash").cast("long") % 5 == 0, F.lag("hash", 2).over(line))})
        return rows.withColumn("parents", F.array_compact(F.array("_first", "_second"))).drop(
            "_first", "_second")

    @cached_property
    def graph_commits(self) -> DataFrame:
        """Commits of a history with forks and merges: an author goes on from their last commit and begins at the last
        one of their team; every fifth commit also merges the team's last commit."""
        team = (F.regexp_extract("author_email", "[0-9]+", 0).cast("long") % TEAMS)
        order = (F.to_date("date"), F.col("hash").cast("long"))
        # an author has one team: the rows of a team stay together for both
        own = W.partitionBy("repo", "_team", "author_email").orderBy(*order)
        near = W.partitionBy("repo", "_team").orderBy(*order)
        rows = self.commits.withColumn("_team", team).withColumn("_near", F.lag("hash", 1).over(near)).withColumn(
            "_own", F.lag("hash", 1).over(own))
        first = F.coalesce("_own", "_near")
        second = F.when((F.col("hash").cast("long") % 5 == 0) & (F.col("_near") != first), F.col("_near"))
        return rows.withColumn("parents", F.array_compact(F.array(first, second))).drop("_team", "_own", "_near")

    @cached_property
    def branches(self) -> DataFrame:
        """Per author a local branch at the last commit and a remote one a commit behind; ``main`` is
        where the first author of the repository stands."""
        back = W.partitionBy("repo", "o_custkey").orderBy(F.col("o_orderdate").desc(),
                                                          F.col("o_orderkey").desc())
        last_two = self.orders.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= 2)
        name = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
        remote = F.col("_r") == 2
        rows = last_two.select(
            "repo", name.alias("branch_name"),
            F.when(remote, F.concat(F.lit("origin/"), name)).otherwise(name).alias("full_name"),
            F.lit(False).alias("is_current"), remote.alias("is_remote"),
            F.col("hash").alias("last_commit_hash"), "o_custkey")
        main = rows.filter(~F.col("is_remote")).groupBy("repo").agg(
            F.min_by("last_commit_hash", "o_custkey").alias("last_commit_hash")).select(
            "repo", F.lit("main").alias("branch_name"), F.lit("main").alias("full_name"),
            F.lit(True).alias("is_current"), F.lit(False).alias("is_remote"), "last_commit_hash")
        return rows.drop("o_custkey").unionByName(main)

    @cached_property
    def tags(self) -> DataFrame:
        dated = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        return self.orders.filter(F.col("o_orderstatus") == "P").select(
            "repo", F.concat(F.lit("v"), F.col("hash")).alias("tag_name"),
            F.col("hash").alias("commit_hash"),
            F.when(dated, F.date_format("date", "yyyy-MM-dd HH:mm:ss")).otherwise("")
            .alias("tagger_date"))

    @cached_property
    def sequence(self) -> DataFrame:
        return lifetimes.commit_sequence(self.orders)

    @cached_property
    def lifetimes(self) -> DataFrame:
        return lifetimes.file_lifetimes(self.changes, self.sequence)

    @cached_property
    def metrics(self) -> DataFrame:
        """Commits with line totals and flattened persistence metrics."""
        bare = self.orders.withColumns({"message": F.lit(""),
                                        "parents": F.array().cast("array<string>")})
        wide = commit_ops.export_commits(
            bare.select("repo", "hash", "date", "message", "parents"), self.changes)
        rows = persistence_metrics(settle(wide))
        return rows.select("*", "architectural_metrics.*")

    @cached_property
    def contents(self) -> DataFrame:
        d = self.read("documents")
        path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
        return d.select(F.lit("docs").alias("repo"), path.alias("filepath"), "text")

    @cached_property
    def events(self) -> DataFrame:
        """Events as commits of a second kind, with real hours."""
        e = self.read("events")
        return e.select(
            F.col("event_type").alias("repo"), F.col("event_id").cast("string").alias("hash"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author_name"),
            F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))
            .alias("author_email"),
            F.col("ts").cast("timestamp").alias("date"), F.col("props").alias("message"))


def half_up(expr: str, digits: int) -> str:
    """SQL for rounding a double the way Spark does: half up on its shortest decimal form."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


_REPO_SQL = "CASE WHEN {k} % 8 < 3 THEN 'core' ELSE 'lib' || ({k} % 8) END"

# name -> (needed expressions, text)
CTE = {
    "ord": ((), f"""SELECT *, {_REPO_SQL.format(k='o_orderkey')} AS repo,
        CAST(o_orderkey AS VARCHAR) AS hash,
        o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS date FROM orders"""),
    "commits": (("ord",), """SELECT repo, hash, c_name AS author_name,
        'c' || o_custkey || '@example.com' AS author_email, date,
        CASE o_orderstatus WHEN 'F' THEN 'fix: resolve ' WHEN 'O' THEN 'feat: add '
             ELSE 'refactor: tidy ' END || lower(o_orderpriority) AS message
        FROM ord JOIN customer ON o_custkey = c_custkey"""),
    "changes": ((), f"""SELECT {_REPO_SQL.format(k='l_orderkey')} AS repo,
        CAST(l_orderkey AS VARCHAR) AS commit_hash,
        lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_')
          || '_' || p_partkey || ['.py', '.js', '.md', '.json', '.yaml', '.css', '.png', ''][p_size % 8 + 1]
          AS filepath,
        CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'M'
             WHEN l_linestatus = 'F' THEN 'D' ELSE 'R' END AS change_type,
        CAST(l_quantity AS BIGINT) AS insertions, CAST(l_linenumber AS BIGINT) AS deletions,
        CAST(l_quantity AS BIGINT) + CAST(l_linenumber AS BIGINT) AS total_churn
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "edges": (("ord",), """SELECT * FROM (
        SELECT repo, hash AS child, 0 AS place, lag(hash, 1) OVER w AS parent FROM ord
          WINDOW w AS (PARTITION BY repo, o_custkey ORDER BY o_orderdate, o_orderkey)
        UNION ALL
        SELECT repo, hash, 1, CASE WHEN o_orderkey % 5 = 0 THEN lag(hash, 2) OVER w END FROM ord
          WINDOW w AS (PARTITION BY repo, o_custkey ORDER BY o_orderdate, o_orderkey))
        WHERE parent IS NOT NULL"""),
    "graph_rows": (("ord",), f"""SELECT repo, hash, coalesce(own, near) AS first,
        CASE WHEN o_orderkey % 5 = 0 AND near <> coalesce(own, near) THEN near END AS second FROM (
          SELECT repo, hash, o_orderkey, lag(hash) OVER a AS own, lag(hash) OVER t AS near FROM ord
          WINDOW a AS (PARTITION BY repo, o_custkey ORDER BY o_orderdate, o_orderkey),
            t AS (PARTITION BY repo, o_custkey % {TEAMS} ORDER BY o_orderdate, o_orderkey))"""),
    "graph": (("graph_rows",), """SELECT repo, hash AS child, 0 AS place, first AS parent FROM graph_rows
        WHERE first IS NOT NULL
        UNION ALL SELECT repo, hash, 1, second FROM graph_rows WHERE second IS NOT NULL"""),
    "graph_heads": (("branches",), "SELECT DISTINCT repo, last_commit_hash AS head FROM branches"),
    "graph_reach": (("graph", "graph_heads"), """SELECT repo, head, head AS hash FROM graph_heads
        UNION SELECT r.repo, r.head, e.parent FROM graph_reach r JOIN graph e ON e.repo = r.repo
          AND e.child = r.hash"""),
    "graph_path": (("graph",), """SELECT repo, hash, hash AS anc, 0 AS back FROM ord
        UNION ALL SELECT p.repo, p.hash, e.parent, back + 1 FROM graph_path p JOIN graph e ON e.repo = p.repo
          AND e.child = p.anc AND e.place = 0"""),
    "graph_listing": (("graph_path", "changes"), """SELECT p.repo, p.hash, filepath FROM graph_path p JOIN (
          SELECT repo, commit_hash, filepath, max(CASE WHEN change_type = 'D' THEN 0 ELSE 1 END) AS open
          FROM changes GROUP BY ALL) c ON c.repo = p.repo AND c.commit_hash = p.anc
        GROUP BY p.repo, p.hash, filepath HAVING arg_min(open, back) = 1"""),
    "branch_rows": (("ord",), """SELECT repo, 'u' || o_custkey AS branch_name,
        CASE WHEN r = 2 THEN 'origin/' ELSE '' END || 'u' || o_custkey AS full_name,
        FALSE AS is_current, r = 2 AS is_remote, hash AS last_commit_hash, o_custkey
        FROM (SELECT *, row_number() OVER (PARTITION BY repo, o_custkey
                ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM ord) WHERE r <= 2"""),
    "branches": (("branch_rows",), """SELECT repo, branch_name, full_name, is_current, is_remote,
        last_commit_hash FROM branch_rows
        UNION ALL
        SELECT repo, 'main', 'main', TRUE, FALSE, arg_min(last_commit_hash, o_custkey)
        FROM branch_rows WHERE NOT is_remote GROUP BY repo"""),
    "tags": (("ord",), """SELECT repo, 'v' || hash AS tag_name, hash AS commit_hash,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
             THEN strftime(date, '%Y-%m-%d %H:%M:%S') ELSE '' END AS tagger_date
        FROM ord WHERE o_orderstatus = 'P'"""),
    "seq": (("ord",), """SELECT repo, hash, date,
        row_number() OVER (PARTITION BY repo ORDER BY date, hash) AS seq FROM ord"""),
    "switches": (("changes", "seq"), """SELECT * FROM (
        SELECT repo, filepath, seq, open,
          lag(open, 1, 0) OVER (PARTITION BY repo, filepath ORDER BY seq) AS before
        FROM (SELECT c.repo, filepath, seq,
                max(CASE WHEN change_type = 'D' THEN 0 ELSE 1 END) AS open
              FROM changes c JOIN seq s ON c.repo = s.repo AND c.commit_hash = s.hash
              GROUP BY c.repo, filepath, seq))
        WHERE open <> before"""),
    "lifetimes": (("switches",), """SELECT repo, filepath, from_seq, to_seq FROM (
        SELECT repo, filepath, open, seq AS from_seq,
          lead(seq) OVER (PARTITION BY repo, filepath ORDER BY seq) AS to_seq FROM switches)
        WHERE open = 1"""),
    "timeline": (("lifetimes", "seq"), """SELECT repo, hash, date, seq,
        CAST(sum(d) OVER (PARTITION BY repo ORDER BY seq) AS BIGINT) AS total_files FROM (
          SELECT s.repo, s.hash, s.date, s.seq, coalesce(e.d, 0) AS d FROM seq s LEFT JOIN (
            SELECT repo, seq, sum(d) AS d FROM (
              SELECT repo, from_seq AS seq, 1 AS d FROM lifetimes
              UNION ALL SELECT repo, to_seq, -1 FROM lifetimes WHERE to_seq IS NOT NULL)
            GROUP BY repo, seq) e ON s.repo = e.repo AND s.seq = e.seq)"""),
    "head": (("lifetimes",), "SELECT repo, filepath FROM lifetimes WHERE to_seq IS NULL"),
    "wide": (("ord", "changes"), """SELECT o.repo, o.hash, o.date,
        CAST(coalesce(files_changed, 0) AS BIGINT) AS files_changed,
        CAST(coalesce(ins, 0) AS BIGINT) AS insertions, CAST(coalesce(del, 0) AS BIGINT) AS deletions,
        CAST(coalesce(ins, 0) + coalesce(del, 0) AS BIGINT) AS lines_changed
        FROM ord o LEFT JOIN (SELECT repo, commit_hash, count(*) AS files_changed,
          sum(insertions) AS ins, sum(deletions) AS del FROM changes GROUP BY repo, commit_hash) c
        ON o.repo = c.repo AND o.hash = c.commit_hash"""),
    "metrics0": (("wide",), """SELECT w.*, age, age / 30.44 AS raw_months,
        greatest(1.0::DOUBLE, age / 30.44::DOUBLE) AS months,
        CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE age / total::DOUBLE END AS survival,
        CASE WHEN top = 0 THEN 0.0::DOUBLE ELSE lines_changed / top::DOUBLE END AS churn
        FROM (SELECT wide.*, date_diff('microsecond', s, date) // 86400000000 AS age,
                date_diff('microsecond', s, e) // 86400000000 AS total, top
              FROM wide JOIN (SELECT repo, min(date) AS s, max(date) AS e, max(lines_changed) AS top
                              FROM wide GROUP BY repo) b USING (repo)) w"""),
    "metrics": (("metrics0",), f"""SELECT repo, hash, date, files_changed, insertions, deletions,
        lines_changed, CAST(age AS BIGINT) AS age_days, {half_up('months', 2)} AS age_months,
        {half_up('lines_changed / months', 2)} AS churn_rate, {half_up('survival', 4)} AS survival_rate,
        {half_up('survival / (1 + churn)', 4)} AS asi FROM metrics0"""),
    "contents": ((), """SELECT 'docs' AS repo, source || '/' || doc_id || '.txt' AS filepath, text
        FROM documents"""),
    "ev": ((), """SELECT event_type AS repo, CAST(event_id AS VARCHAR) AS hash,
        'user' || user_id AS author_name, 'u' || user_id || '@example.com' AS author_email,
        ts AS date, props AS message FROM events"""),
    "undotted": ((), """SELECT p, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '^\\.+', '') AS u,
        regexp_extract(p, '([^/]*)$', 1) AS n FROM paths"""),
}


def with_tables(body: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """Put the common table expressions that a query needs in front of it."""
    done: dict[str, str] = {}

    def add(name):
        before, text = CTE[name]
        for other in before:
            add(other)
        done.setdefault(name, text)

    for name in needs:
        add(name)
    done.update(extra or {})
    if not done:
        return body
    listed = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH RECURSIVE {listed}\n{body}"

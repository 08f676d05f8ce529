"""Writes the adapters' tables as history dumps, so that the readers have something to read."""

from pyspark.sql import functions as F

from revloom.operators.lifetimes import files_at, head_files
from revloom.plans.runtime import scratch_path, settle
from revloom.sources.dumps import FIELD, RECORD


# files of one part that the paths of a tree are written in: a record is small, and that of the next commit close to it
TREE_FILES = 128


def _write(df, root, kind, separator, compression="none"):
    df.select("repo", "value").write.partitionBy("repo").option("lineSep", separator).text(
        f"{root}/{kind}", compression=compression)


def _paths(t):
    """Changes of each commit in a fixed order (a commit of the adapters holds few)."""
    return t.changes.groupBy("repo", F.col("commit_hash").alias("hash")).agg(F.array_sort(
        F.collect_list(F.struct("deletions", "insertions", "filepath", "change_type"))).alias("_c"))


def _body(t, line, paths=None):
    """Path lines of each commit, from :func:`_paths` where they were settled."""
    rows = _paths(t) if paths is None else paths
    return rows.select("repo", "hash", F.array_join(F.transform("_c", line), "\n").alias("body"))


def _status_line(c):
    path = c["filepath"]
    return (F.when(c["change_type"] == "R", F.concat(F.lit("R100\told/"), path, F.lit("\t"), path))
            .otherwise(F.concat(c["change_type"], F.lit("\t"), path)))


def _numstat_line(c):
    path = F.when(c["change_type"] == "R", F.regexp_replace(c["filepath"], "^([^/]*)/",
                                                            "{was => $1}/")
                  ).otherwise(c["filepath"])
    binary = F.endswith(c["filepath"], F.lit(".png"))
    ins = F.when(binary, "-").otherwise(c["insertions"].cast("string"))
    dels = F.when(binary, "-").otherwise(c["deletions"].cast("string"))
    return F.concat_ws("\t", ins, dels, path)


def write_log(t, kinds=("log", "numstat")) -> str:
    root = scratch_path(t.spark, "dump")
    # settled where several kinds are written from it
    paths = settle(_paths(t)) if len(kinds) > 1 else None
    if "log" in kinds:
        rows = t.commits_with_parents.join(_body(t, _status_line, paths), ["repo", "hash"], "left")
        header = F.concat_ws(FIELD, "hash", "author_name", "author_email",
                             F.unix_seconds("date").cast("string"), F.array_join("parents", " "),
                             F.concat("message", F.lit("\n")), F.lit(""))
        _write(rows.select("repo", F.concat(header, F.lit("\n"), F.coalesce("body", F.lit("")),
                                            F.lit("\n")).alias("value")), root, "log", RECORD)
    if "numstat" in kinds:
        rows = _body(t, _numstat_line, paths)
        _write(rows.select("repo", F.concat("hash", F.lit(FIELD + "\n"), "body", F.lit("\n"))
                           .alias("value")), root, "numstat", RECORD)
    return root


def write_graph_log(t) -> str:
    """Log and numstat of the history with merges, as ``--all -m`` lists it: one record per parent. Against its second
    parent a merge changes the lines with an odd number, with 1000 more insertions."""
    root = scratch_path(t.spark, "dump")
    lines = t.changes.groupBy("repo", F.col("commit_hash").alias("hash")).agg(F.array_sort(
        F.collect_list(F.struct("deletions", "insertions", "filepath", "change_type"))).alias("_c"))
    # settled: both kinds are written from it
    rows = settle(t.graph_commits.join(lines, ["repo", "hash"], "left"))
    second = F.transform(F.filter("_c", lambda c: c["deletions"] % 2 == 1),
                         lambda c: c.withField("insertions", c["insertions"] + 1000))

    def text(cells, line):
        return F.coalesce(F.array_join(F.transform(cells, line), "\n"), F.lit(""))

    header = F.concat_ws(FIELD, "hash", "author_name", "author_email", F.unix_seconds("date").cast("string"),
                         F.array_join("parents", " "), F.concat("message", F.lit("\n")), F.lit(""))
    for kind, start, line in (("log", header, _status_line),
                              ("numstat", F.concat("hash", F.lit(FIELD)), _numstat_line)):
        record = lambda cells: F.concat(start, F.lit("\n"), text(cells, line), F.lit("\n"))  # noqa: B023, E731
        both = F.concat(record(F.col("_c")), F.lit(RECORD), record(second))
        _write(rows.select("repo", F.when(F.size("parents") > 1, both).otherwise(record(F.col("_c"))).alias("value")),
               root, kind, RECORD, "gzip")
    return root


def write_wide_log(t) -> str:
    """The wide dialect, children before their parents. Authors wrote a day before; messages go on over blank lines, hold count
    lines, and quote the header of the first parent, after text and after a blank line."""
    root = scratch_path(t.spark, "dump")
    full = lambda c: F.lpad(c, 40, "0")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    authored = F.col("date") - F.make_dt_interval(F.lit(1))
    about = t.commits_with_parents.withColumn("header", F.concat_ws(
        "|", full(F.col("hash")), F.concat(F.col("author_name"), F.lit(" | team")), "author_email", iso(authored), F.lit("Builder"),
        F.lit("b@x.org"), iso(F.col("date")), F.concat("message", F.lit(" | done")),
        F.array_join(F.transform("parents", full), " ")))
    quoted = about.select("repo", F.col("hash").alias("_p"), F.col("header").alias("_quote"))
    rows = about.withColumn("_p", F.get("parents", F.lit(0))).join(quoted, ["repo", "_p"], "left").join(
        _body(t, _numstat_line), ["repo", "hash"], "left")
    quote = F.concat(F.coalesce("_quote", F.lit("none")), F.lit("|x"))
    value = F.concat(F.col("header"), F.lit("|"), "message", F.lit(" | done\n\nsee\n"), quote, F.lit("\n1\t2\tcounted\n\n"), quote,
                     F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    # files in order: a large repository is written by several tasks
    order = (F.col("repo").asc(), F.to_date("date").desc(), F.col("hash").cast("long").desc())
    ordered = rows.select("repo", "date", "hash", value.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("repo", "value").write.partitionBy("repo").text(f"{root}/wide", compression="gzip")
    return f"{root}/wide"


def write_tree(t) -> str:
    """The tree of every repository's head, one record per file, each with a submodule line to skip."""
    root = scratch_path(t.spark, "dump")
    line = F.concat(F.lit("100644 blob 0000  "), F.length("filepath").cast("string"), F.lit("\t"),
                    "filepath")
    lines = head_files(t.lifetimes).select("repo", "filepath", F.concat(
        F.lit("head" + FIELD + "\n"), line,
        F.lit("\n160000 commit 0000  -\t"), "filepath", F.lit(".sub\n")).alias("value"))
    _write(lines, root, "tree", RECORD)
    return root


def write_trees(t) -> str:
    """The trees of each repository's last commit of every month, in records of a commit and a part of its paths, compressed.
    A file's size and object id change with the year."""
    root = scratch_path(t.spark, "dump")
    months = t.sequence.groupBy("repo", F.date_format("date", "yyyy-MM").alias("_m")).agg(
        F.max_by(F.struct("hash", "seq", F.year("date").alias("year")), "seq").alias("c")).select("repo", "c.*")
    size = F.col("year") + F.length("filepath")
    line = F.concat(F.lit("100644 blob b"), F.col("year").cast("string"), F.lit("    "), size.cast("string"), F.lit("\t"),
                    "filepath")
    most = t.lifetimes.groupBy("repo").count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.xxhash64("filepath"), F.lit(1 + most // TREE_FILES))
    # a part's records of all months are made by one task, one after the other
    rows = files_at(t.lifetimes.withColumn("_part", part), months, ["_part"], together=["repo", "_part"])
    lines = rows.select("repo", "_part", "seq", "hash", line.alias("line")).groupBy("repo", "_part", "seq", "hash").agg(
        F.collect_list("line").alias("l"))
    _write(lines.select("repo", F.concat("hash", F.lit(FIELD + "\n"), F.array_join("l", "\n"), F.lit("\n")).alias("value")),
           root, "tree", RECORD, "gzip")
    return root


def write_refs(t) -> str:
    root = scratch_path(t.spark, "dump")
    nul = "\u0000"
    refs = t.branches.select("repo", F.concat_ws(
        nul, "full_name", "last_commit_hash", F.lit("2001-01-01"), F.lit("someone"), F.lit(""),
        F.when(F.col("is_current"), "*").otherwise(" "), F.lit("")).alias("value"))
    _write(refs, root, "refs", "\n")
    tags = t.tags.select("repo", F.when(F.col("tagger_date") == "", F.concat_ws(
        nul, "tag_name", "commit_hash")).otherwise(F.concat_ws(
            nul, "tag_name", "commit_hash", "tagger_date", F.lit("someone"), F.lit("release")))
        .alias("value"))
    _write(tags, root, "tags", "\n")
    return root


def write_pipe_log(t) -> str:
    root = scratch_path(t.spark, "dump") + "/pipe"
    rows = t.commits.join(_body(t, _status_line), ["repo", "hash"], "left")
    header = F.concat_ws("|", "hash", "author_name", "author_email",
                         F.unix_seconds("date").cast("string"),
                         F.concat("message", F.lit(" | more")))
    _write(rows.select("repo", F.concat(header, F.lit("\n"), F.coalesce("body", F.lit("")))
                       .alias("value")), root[:-5], "pipe", "\n\n")
    return root

"""Named analyses over a :class:`History`: what they need, what they return, what was skipped."""

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from revloom.operators import clean, commits, contributors, files, stats
from revloom.operators.persistence import asi_trend, persistence_metrics
from revloom.plans.runtime import remove_path, settle
from revloom.sources.tables import History

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class AnalysisConfig:
    """Settings of a run."""

    modules: tuple[str, ...] = ("commits", "contributors", "files", "hotspots")
    date_range: str | None = None
    exclude_paths: tuple[str, ...] = ()
    min_file_changes: int = 2
    contributors_min_commits: int = 5
    top_n: int = 20


@dataclass(frozen=True)
class Analysis:
    name: str
    requires: frozenset[str]
    run: Callable[[History, AnalysisConfig], dict[str, DataFrame]]

    def can_run(self, history: History) -> bool:
        return history.has(self.requires)


@dataclass
class Outcome:
    tables: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)

    def status(self, spark: SparkSession) -> DataFrame:
        rows = [(name, "done", "") for name in self.tables]
        rows += [(name, "skipped", reason) for name, reason in self.skipped.items()]
        return spark.createDataFrame(rows, "analysis string, status string, reason string")


REGISTRY: dict[str, Analysis] = {}


def analysis(name: str, *requires: str):
    """Register a function as a named analysis."""
    def register(run):
        REGISTRY[name] = Analysis(name, frozenset(requires), run)
        return run
    return register


def filtered(history: History, config: AnalysisConfig) -> History:
    """Date range, path exclusion and the least number of changes per file, in this order."""
    commits_in = history.commits
    keep_commits = None if commits_in is None else clean.filter_dates(commits_in, config.date_range)
    changes = history.file_changes
    if changes is not None:
        if config.date_range and "date" not in changes.columns and commits_in is not None:
            changes = files.date_changes(changes, history.commits)
        changes = clean.filter_dates(changes, config.date_range)
        changes = clean.exclude_paths(changes, config.exclude_paths)
        changes = clean.frequent_files(changes, config.min_file_changes)
    return History(**{**history.tables(), "commits": keep_commits,
                      **({"file_changes": changes} if changes is not None else {})})


@analysis("commits", "commits")
def _commits(history, config):
    c = history.commits
    return {"monthly_commits": commits.monthly_commits(c), "weekdays": commits.weekday_counts(c),
            "hours": commits.hour_counts(c), "years": commits.year_counts(c),
            "overview": commits.commit_overview(c)}


@analysis("contributors", "commits")
def _contributors(history, config):
    people = (history.contributors if history.contributors is not None
              else contributors.contributors_from_commits(history.commits))
    least, n = config.contributors_min_commits, config.top_n
    return {"active_contributors": contributors.active_contributors(people, least, n),
            "overview": contributors.contributor_overview(people, least, n),
            "tiers": contributors.contributor_tiers(people),
            "pareto": contributors.pareto(people),
            "histogram": stats.histogram(people, "commit_count"),
            "monthly_active": commits.monthly_active_contributors(history.commits)}


@analysis("files", "file_changes")
def _files(history, config):
    changes = history.file_changes
    out = {"file_extension_counts": files.extension_counts(changes),
           "overview": files.change_overview(changes)}
    if history.commits is not None:
        dated = (changes if "date" in changes.columns
                 else files.date_changes(changes, history.commits))
        out["monthly_file_extensions"] = files.monthly_extensions(dated)
    if history.language_statistics is not None:
        out["languages"] = files.language_shares_with_others(history.language_statistics)
    return out


@analysis("hotspots", "file_changes")
def _hotspots(history, config):
    changes = history.file_changes
    return {"top_files": files.top_changed_files(changes, config.top_n),
            "directories": files.directory_activity(changes),
            "depths": files.depth_distribution(changes),
            "hotspot_analysis": files.file_heat(changes),
            "heat_counts": files.file_heat_counts(changes),
            "overview": files.change_frequency_summary(changes)}


@analysis("architectural", "commits")
def _architectural(history, config):
    rows = history.commits
    if "asi" not in rows.columns:
        if "architectural_metrics" not in rows.columns:
            if "lines_changed" not in rows.columns:
                raise ValueError("commits carry no persistence metrics")
            rows = persistence_metrics(rows)
        rows = rows.select("*", "architectural_metrics.*")
    return {"summary": stats.asi_summary(rows), "trend": asi_trend(rows),
            "architectural_metrics_summary": stats.describe(rows),
            "correlations": stats.correlations(rows),
            "asi_histogram": stats.histogram(rows, "asi"),
            "age_histogram": stats.histogram(rows, "age_days"),
            "lines_by_asi": stats.box_plot(rows)}


@analysis("activity", "commits")
def _activity(history, config):
    return {"heatmap": commits.activity_heatmap(history.commits),
            "peaks": commits.activity_peaks(history.commits)}


def run(history: History, config: AnalysisConfig = AnalysisConfig(), ready: History | None = None) -> Outcome:
    """Declare the tables of all wanted analyses. Unknown names, missing tables and failures are
    logged and skipped. ``ready``: the history where it has been filtered already."""
    outcome = Outcome()
    ready = filtered(history, config) if ready is None else ready
    for name in config.modules:
        module = REGISTRY.get(name)
        if module is None:
            outcome.skipped[name] = "unknown analysis"
        elif not module.can_run(ready):
            missing = sorted(module.requires - set(ready.tables()))
            outcome.skipped[name] = "missing tables: " + ", ".join(missing)
        else:
            try:
                outcome.tables[name] = module.run(ready, config)
            except Exception as error:  # one failing analysis must not stop the others
                log.exception("analysis %s failed", name)
                outcome.skipped[name] = f"failed: {error}"
    for name, reason in outcome.skipped.items():
        log.warning("skipped %s: %s", name, reason)
    return outcome


@dataclass
class Written:
    """What became of a run: (analysis, table, status, reason, rows) per table, and where the tables are."""

    root: str
    rows: list[tuple[str, str | None, str, str, int | None]] = field(default_factory=list)

    def status(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows, "analysis string, table_name string, status string, reason string, rows long")

    def read(self, spark: SparkSession, analysis: str, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{analysis}/{table}")


def _write_module(name: str, tables: dict[str, DataFrame], root: str) -> list[tuple]:
    """Write the tables of one analysis; their rows are counted as they are written."""
    done = []
    for table, rows in tables.items():
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/{name}/{table}")
        done.append((name, table, "done", "", seen.get["rows"]))
    return done


def _settled_changes(ready: History, config: AnalysisConfig) -> History:
    """The filtered changes written once, if a wanted analysis needs them: many tables read them."""
    wanted = [REGISTRY[name] for name in config.modules if name in REGISTRY]
    if not any("file_changes" in w.requires and w.can_run(ready) for w in wanted):
        return ready
    try:
        return replace(ready, file_changes=settle(ready.file_changes))
    except Exception as error:  # recorded by the analyses that read them
        log.warning("changes could not be written: %s", error)
        return ready


def run_and_write(spark: SparkSession, history: History, root: str,
                  config: AnalysisConfig = AnalysisConfig()) -> Written:
    """Run the wanted analyses to the end and write their tables to ``root/<analysis>/<table>``.

    Unlike :func:`run`, which only declares tables, this knows what happened when they were computed. The jobs of an
    analysis are one job group of its name, so that it can be cancelled on its own. An analysis that fails or is cancelled
    is recorded with its reason and leaves no tables; the others are written.
    """
    ready = _settled_changes(filtered(history, config), config)
    outcome, written, context = run(history, config, ready), Written(root.rstrip("/")), spark.sparkContext
    written.rows += [(name, None, "failed" if reason.startswith("failed: ") else "skipped", reason, None)
                     for name, reason in outcome.skipped.items()]
    for name, tables in outcome.tables.items():
        context.setJobGroup(name, f"analysis {name}", interruptOnCancel=True)
        try:
            written.rows += _write_module(name, tables, written.root)
        except Exception as error:  # one failing analysis must not stop the others
            reason = str(error).strip().split("\n")[0]
            status = "cancelled" if "cancelled" in str(error).lower() else "failed"
            log.warning("analysis %s %s: %s", name, status, reason)
            remove_path(spark, f"{written.root}/{name}")
            written.rows.append((name, None, status, reason, None))
        finally:
            for local in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(local, None)
    return written

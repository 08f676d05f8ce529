"""Table schemas. Every table leads with ``repo`` so that work splits by repository and beyond."""

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


COMMITS = _struct(repo=_S, hash=_S, author_name=_S, author_email=_S, date=_TS, message=_S,
                  parents=T.ArrayType(_S))

FILE_CHANGES = _struct(repo=_S, commit_hash=_S, filepath=_S, change_type=_S, insertions=_L,
                       deletions=_L, total_churn=_L, old_path=_S)

FILE_PRESENCE = _struct(repo=_S, commit_hash=_S, filepath=_S)

BRANCHES = _struct(repo=_S, branch_name=_S, full_name=_S, is_current=_B, is_remote=_B,
                   last_commit_hash=_S, last_commit_date=_S, last_commit_author=_S, upstream=_S,
                   commit_count=_L, is_merged=_B)

TAGS = _struct(repo=_S, tag_name=_S, commit_hash=_S, tagger_date=_S, tagger_name=_S, subject=_S,
               is_annotated=_B)

ARCHITECTURAL_METRICS = _struct(age_days=_L, age_months=_D, churn_rate=_D, survival_rate=_D, asi=_D)

EXPORT_COMMITS = _struct(
    hash=_S, author_name=_S, author_email=_S, author_date=_S, committer_name=_S, committer_email=_S,
    commit_date=_S, subject=_S, parent_hashes=_S, full_message=_S, is_merge=_B, message_length=_L,
    files_changed=_L, insertions=_L, deletions=_L, lines_changed=_L,
    architectural_metrics=ARCHITECTURAL_METRICS)

EXPORT_CHANGES = _struct(
    commit_hash=_S, commit_date=_S, change_type=_S, file_path=_S, old_file_path=_S,
    file_extension=_S, language=_S, is_binary=_B, directory_depth=_L)

CONTRIBUTORS = _struct(
    author_name=_S, author_email=_S, commit_count=_L, first_commit_date=_S, last_commit_date=_S,
    total_insertions=_L, total_deletions=_L, total_lines_changed=_L, files_touched=_L,
    avg_lines_per_commit=_D)

LANGUAGE_STATISTICS = _struct(language=_S, file_count=_L, percentage=_D)

REPOSITORY_INFO = _struct(
    repo_name=_S, repo_path=_S, remote_url=_S, current_branch=_S, total_commits=_L, git_size_kb=_L,
    working_tree_clean=_B, has_submodules=_B, default_branch=_S, repo_age_days=_L)

EXPORT_DOCUMENT = _struct(
    repository_info=REPOSITORY_INFO,
    commits=T.ArrayType(EXPORT_COMMITS),
    file_changes=T.ArrayType(EXPORT_CHANGES),
    branches=T.ArrayType(T.StructType(BRANCHES.fields[1:])),
    contributors=T.ArrayType(CONTRIBUTORS),
    tags=T.ArrayType(T.StructType(TAGS.fields[1:])),
    language_statistics=T.ArrayType(LANGUAGE_STATISTICS),
    extraction_date=_S)

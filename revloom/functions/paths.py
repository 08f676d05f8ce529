"""Path functions as Column expressions (no Python per row)."""

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from revloom.functions.lookups import (
    BINARY_EXTENSIONS, CONFIG_EXTENSIONS, CONFIG_NAMES, DOC_DIRECTORIES, DOC_EXTENSIONS,
    EXTENSION_LANGUAGE, TOPIC_RULES)


def _col(path):
    return F.col(path) if isinstance(path, str) else path


def path_name(path) -> Column:
    """Last part of the path."""
    return F.substring_index(_col(path), "/", -1)


def _undotted(path) -> Column:
    # leading dots belong to the name, not to a suffix (".gitignore" has none)
    return F.regexp_replace(path_name(path), r"^\.+", "")


def path_suffix(path) -> Column:
    """Last suffix, lower case, '' if there is none or the name ends with a dot."""
    return F.lower(F.regexp_extract(_undotted(path), r"(?s)^.+(\.[^.]+)$", 1))


def path_suffixes(path) -> Column:
    """All suffixes joined (".tar.gz"), lower case, or ``no_ext``."""
    found = F.lower(F.regexp_extract(_undotted(path), r"(?s)^[^.]+(\..*[^.])$", 1))
    return F.when(found == "", "no_ext").otherwise(found)


def path_stem(path) -> Column:
    """Name without its last suffix."""
    name = path_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(path_suffix(path)))


def path_parts(path) -> Column:
    return F.split(_col(path), "/")


def path_depth(path) -> Column:
    """Number of parts; a file at the root has depth 1."""
    p = _col(path)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) + 1


def directory_depth(path) -> Column:
    """Number of directories above the file."""
    return path_depth(path) - 1


def path_dir(path, root: str = "root") -> Column:
    """Parent directory, or ``root`` for files without one."""
    p = _col(path)
    above = F.substring(p, F.lit(1), F.length(p) - F.length(path_name(p)) - 1)
    return F.when(F.contains(p, F.lit("/")), above).otherwise(root)


def path_head(path) -> Column:
    """The path up to its last slash, with it; '' for files without a directory."""
    p = _col(path)
    return F.substring(p, F.lit(1), F.length(p) - F.length(path_name(p)))


def top_level_dir(path) -> Column:
    """First part (the file itself at the root)."""
    return F.substring_index(_col(path), "/", 1)


def path_prefix(path, depth: int = 1) -> Column:
    """Directory at ``depth`` parts, or '.' if the path is not deeper than that."""
    p = _col(path)
    return F.when(path_depth(p) <= depth, ".").otherwise(F.substring_index(p, "/", depth))


def language_key(path) -> Column:
    """The extension that decides the language: special names win over the suffix.

    Group by this key first and translate the few groups with :func:`language_name`.
    """
    name = F.lower(path_name(path))
    return (F.when(F.contains(name, F.lit("dockerfile")), ".dockerfile")
            .when(F.contains(name, F.lit("makefile")), ".makefile")
            .otherwise(path_suffix(path)))


def language_name(key) -> Column:
    pairs = [F.lit(x) for item in EXTENSION_LANGUAGE.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(key)), F.lit("Other"))


def language_of(path) -> Column:
    """Programming language of a path, ``Other`` if unknown."""
    return language_name(language_key(path))


def is_binary_path(path) -> Column:
    """True for suffixes in the fixed binary table."""
    return path_suffix(path).isin(*BINARY_EXTENSIONS)


def is_test_file(path) -> Column:
    """Root files: ``test_*`` or ``*_test.py``; nested files: any part contains ``test``."""
    p = F.lower(_col(path))
    at_root = F.startswith(p, F.lit("test_")) | F.endswith(p, F.lit("_test.py"))
    return F.when(~F.contains(p, F.lit("/")), at_root).otherwise(F.contains(p, F.lit("test")))


def is_config_file(path) -> Column:
    """A configuration suffix, or a stem that contains a configuration name."""
    p = F.lower(_col(path))
    return path_suffix(p).isin(*CONFIG_EXTENSIONS) | path_stem(p).rlike("|".join(CONFIG_NAMES))


def is_documentation(path) -> Column:
    """A documentation suffix, or any part that is a documentation directory."""
    p = F.lower(_col(path))
    in_docs = F.arrays_overlap(path_parts(p), F.array(*map(F.lit, DOC_DIRECTORIES)))
    return path_suffix(p).isin(*DOC_EXTENSIONS) | in_docs


def has_suffix(path, suffixes) -> Column:
    """The last suffix, in its own case, is one of ``suffixes``."""
    raw = F.regexp_extract(_undotted(path), r"(?s)^.+(\.[^.]+)$", 1)
    return raw.isin(*suffixes) if suffixes else F.lit(False)


def hotspot_topic(path) -> Column:
    """Topic of a file by substring rules; the first matching rule wins."""
    p = F.lower(_col(path))
    expr = None
    for topic, needles, barred in TOPIC_RULES:
        hit = p.rlike("|".join(n.replace(".", r"\.") for n in needles))
        if barred:
            hit = hit & ~F.contains(p, F.lit(barred))
        expr = F.when(hit, topic) if expr is None else expr.when(hit, topic)
    return expr.otherwise("Other")


def ancestor_dirs(path) -> Column:
    """All directories above the file, outermost first (empty for a root file)."""
    p = _col(path)
    return F.when(F.contains(p, F.lit("/")),
                  F.transform(F.sequence(F.lit(1), path_depth(p) - 1),
                              lambda i: F.array_join(F.slice(path_parts(p), F.lit(1), i), "/"))
                  ).otherwise(F.array().cast("array<string>"))

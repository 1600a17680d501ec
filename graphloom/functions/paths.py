"""Names and paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a display name drops.
NAME_NOISE = ("Instruct", "preview", "claude-")


def short_name(model: Column) -> Column:
    """The part of a model name after the last slash."""
    return F.element_at(F.split(model, "/"), -1)


def file_name_of(model: Column) -> Column:
    """A model name as file name: slashes of either kind become underscores."""
    return F.translate(model, "/\\", "__")


def safe_file_name(name: Column, longest: int = 200) -> Column:
    """Unsafe characters as underscores, no control characters, runs of underscores and space as one, edges trimmed.

    A name that is still too long is cut before its extension.
    """
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?U)[_\s]+", "_"), r"^[._]+|[._]+$", "")
    extension = F.regexp_extract(clean, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(clean, F.lit(1), F.length(clean) - F.length(extension))
    cut = F.concat(F.substring(stem, F.lit(1), F.greatest(F.lit(0), F.lit(longest - 1) - F.length(extension))), extension)
    return F.when(F.length(clean) > longest, cut).otherwise(clean)


def human_size(size: Column) -> Column:
    """Bytes with a unit and one decimal, in steps of 1,024."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    text = [F.format_string(f"%.1f {unit}", F.bround(size.cast("double") / float(1024**k), 1)) for k, unit in enumerate(units)]
    out = F.when(size < 1024, text[0])
    for k in range(1, len(units) - 1):
        out = out.when(size < 1024 ** (k + 1), text[k])
    return out.otherwise(text[-1])


def first_segment(path: Column, start: str) -> Column:
    """The first path segment that begins with ``start``; NULL if none does."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/)({start}[^/]*)", 1), F.lit(""))


def last_segment(path: Column, start: str) -> Column:
    """The last such segment."""
    found = F.filter(F.split(path, "/"), lambda s: s.startswith(start))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def below_marker(path: Column, marker: str, fallback: str = "domain_") -> Column:
    """The path from ``marker`` on; else from the first segment that begins with ``fallback``; else as it is."""
    from_marker = F.nullif(F.regexp_extract(path, rf"(?:^|/)({marker}/.*)$", 1), F.lit(""))
    from_fallback = F.nullif(F.regexp_extract(path, rf"(?:^|/)({fallback}.*)$", 1), F.lit(""))
    return F.coalesce(from_marker, from_fallback, path)


def is_absolute(path: Column) -> Column:
    """A Unix or a Windows absolute path."""
    return F.coalesce(path.rlike(r"^(/|[A-Za-z]:[\\/])"), F.lit(False))


def relative(path: Column, marker: str) -> Column:
    """An absolute path cut at the marker; others unchanged."""
    return F.when(is_absolute(path), below_marker(F.translate(path, "\\", "/"), marker)).otherwise(path)


def domain_title(domain: Column) -> Column:
    """``domain_x_y`` as a title: the prefix dropped, words capitalised."""
    return F.initcap(F.replace(F.regexp_replace(domain, "^domain_", ""), F.lit("_"), F.lit(" ")))


def display_name(model: Column) -> Column:
    """The short name without noise words and outer dashes."""
    out = short_name(model)
    for word in NAME_NOISE:
        out = F.replace(out, F.lit(word), F.lit(""))
    return F.regexp_replace(out, "^-+|-+$", "")

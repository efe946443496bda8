"""Parts of file paths.

``windows`` splits at both slashes and knows drives and network shares; ``posix`` splits at "/" only,
so a back-slashed path is one segment.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drive letter or \\server\share in front of the path.
WINDOWS_ANCHOR = r"^(?:[\\/]{2}[^\\/]+[\\/]+[^\\/]+|[^\\/]:)"
WINDOWS_ROOTED = r"^(?:[\\/]|[^\\/]:)"


def _segments_of(path: Column, semantics: str) -> tuple[Column, str]:
    if semantics == "windows":
        return F.regexp_replace(path, WINDOWS_ANCHOR, ""), r"[^\\/]+"
    if semantics == "posix":
        return path, r"[^/]+"
    raise ValueError(f"unknown path semantics: {semantics}")


def basename(path: Column, semantics: str = "windows") -> Column:
    """Last non-empty segment, "" if there is none."""
    rest, segment = _segments_of(path, semantics)
    if semantics == "posix":
        return F.regexp_extract(rest, f"({segment})/*$", 1)
    # An ordinary path needs no regular expression; shares, drive-relative paths and trailing
    # separators take the exact way.
    flat = F.replace(path, F.lit("/"), F.lit("\\"))
    tail = F.substring_index(flat, "\\", -1)
    plain = (tail != "") & ~F.contains(tail, F.lit(":")) & ~F.startswith(flat, F.lit("\\\\"))
    return F.when(plain, tail).otherwise(F.regexp_extract(rest, rf"({segment})[\\/]*$", 1))


def path_depth(path: Column, semantics: str = "windows") -> Column:
    """Number of parts; drive, share or leading separator count as one part."""
    rest, segment = _segments_of(path, semantics)
    rooted = path.rlike(WINDOWS_ROOTED if semantics == "windows" else "^/")
    return F.regexp_count(rest, F.lit(segment)) + rooted.cast("int")

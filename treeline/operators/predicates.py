"""Predicates over paths, digests and names. Each gives a Column; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that a scan leaves out unless included.
BUILTIN_EXCLUDES = ("node_modules", "target", "dist", "build", "__pycache__", ".venv")
#: The folder of local state at the root of a tree; callers with trees of another tool set its name.
STATE_DIR = ".treeline"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_dotenv(path: Column) -> Column:
    """The last component begins with .env; a directory of such a name taints nothing below."""
    return F.startswith(basename(path), F.lit(".env"))


def matches_prefix(path: Column, prefix: Column) -> Column:
    """Equal, or below by whole components."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def matches_any(path: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in prefixes]).cast("array<string>"), lambda p: matches_prefix(path, p))


def has_include_below(path: Column, includes: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in includes]).cast("array<string>"), lambda p: F.startswith(p, F.concat(path, F.lit("/"))) & (F.length(p) > F.length(path) + 1))


def ancestors(path: Column) -> Column:
    """Proper directory prefixes, shortest first; empty for a single component."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def path_valid(path: Column) -> Column:
    """No empty component, no '..' anywhere, no '.' in front, and not the state directory in any ASCII case."""
    parts = F.split(path, "/")
    first = F.element_at(parts, 1)
    return ~(F.exists(parts, lambda p: (p == "") | (p == "..")) | (first == ".") | (F.lower(first) == STATE_DIR))


def is_chunk_hash(value: Column) -> Column:
    return F.rlike(value, F.lit("^[0-9a-f]{64}$"))


def valid_name(value: Column) -> Column:
    """1 to 128 bytes, neither '.' nor '..', no control character and no slash."""
    return F.octet_length(value).between(1, 128) & ~value.isin(".", "..") & ~F.rlike(value, F.lit(r"[\x00-\x1f\x7f/]"))


def valid_workspace_id(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^[A-Za-z0-9._-]{1,128}$")) & F.rlike(value, F.lit("[A-Za-z0-9]"))


def is_wrapped_key(value: Column) -> Column:
    """Lower-case hex of 60 to 65536 bytes."""
    return F.rlike(value, F.lit("^([0-9a-f]{2})+$")) & (F.length(value) / 2).between(60, 65536)


def is_hex(value: Column, size: int) -> Column:
    return F.rlike(value, F.lit(f"^[0-9a-f]{{{2 * size}}}$"))


def is_git_path(path: Column) -> Column:
    return matches_prefix(path, F.lit(".git"))


def plain_mode(mode: Column) -> Column:
    return F.bitwise_and(mode, F.lit(0o777)) if hasattr(F, "bitwise_and") else mode.bitwiseAND(0o777)


def state_only(paths: Column) -> Column:
    """An event to ignore: it has paths, and all are under the state directory."""
    return (F.size(paths) > 0) & F.forall(paths, lambda p: matches_prefix(p, F.lit(STATE_DIR)))


def shadowed(path: Column, includes: list[str], builtin: tuple[str, ...] = BUILTIN_EXCLUDES) -> Column:
    """The nearest ancestor that decides: an included one says no, one with a built-in name says yes; none, no."""
    deciding = F.filter(F.reverse(ancestors(path)), lambda a: matches_any(a, includes) | basename(a).isin(*builtin))
    nearest = F.element_at(F.concat(deciding, F.array(F.lit(""))), 1)
    return (nearest != "") & ~matches_any(nearest, includes)


def captured(path: Column, includes: list[str], excludes: list[str], ignored: Column) -> Column:
    """Precedence of the scan's filters for a file: the user's excludes, then includes, then the state directory and
    built-in names of directories, then .env files and the root .git, then the ignore rules."""
    below_state = F.lower(F.element_at(F.split(path, "/"), 1)) == STATE_DIR
    return (
        F.when(below_state | matches_any(path, excludes), False)
        .when(is_git_path(path), True)
        .when(shadowed(path, includes), False)
        .when(matches_any(path, includes) | is_dotenv(path), True)
        .otherwise(~ignored)
    )

"""Path, language and workspace expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import contains_any, strip

DEFAULT_WORKSPACE = "default_workspace"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix_of(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1))


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def language_of(path: Column) -> Column:
    """Language by extension, 'text' when unknown."""
    table = F.create_map(*[F.lit(x) for pair in rules.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix_of(path)), F.lit("text"))


def module_of(path: Column) -> Column:
    """First path part, or 'root' for a top-level file."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("root")


def folder_of(path: Column) -> Column:
    """Parent folder, '' for a top-level file."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes or text."""
    return F.sha2(content, 256)


def wrapped(path: Column) -> Column:
    """Lower-cased path with forward slashes and exactly one slash at each end."""
    slashed = F.translate(path, "\\", "/")
    return F.concat(F.lit("/"), F.lower(F.btrim(slashed, F.lit("/"))), F.lit("/"))


def is_noise_path(path: Column, include_app: bool = False) -> Column:
    """Build, tool-chain and vendor paths; optionally everything under app/."""
    norm = wrapped(path)
    noise = contains_any(norm, rules.NOISE_SEGMENTS)
    return (norm.startswith("/app/") | noise) if include_app else noise


def is_domain_source(path: Column) -> Column:
    """Whether a path may serve as fallback context."""
    norm = wrapped(path)
    ext = suffix_of(F.btrim(norm, F.lit("/")))
    known = ext.isin(*rules.DOMAIN_EXTENSIONS)
    excluded = (
        norm.contains("/data/tools/") | norm.startswith("/tools/") | contains_any(norm, rules.LOW_SIGNAL_DIRS)
    )
    bare = (ext == "") & (norm.startswith("/src/") | norm.startswith("/assets/"))
    return ~excluded & (known | (contains_any(norm, rules.CODE_DIRS) & bare))


def normalize_workspace(workspace: Column, default: str = DEFAULT_WORKSPACE) -> Column:
    """Trimmed, lower-cased id with other characters replaced by '_' (P17)."""
    raw = F.lower(strip(F.coalesce(workspace, F.lit(""))))
    return F.when(raw == "", F.lit(default)).otherwise(F.regexp_replace(raw, r"[^\p{L}\p{N}_-]", "_"))


def scoped_id(workspace: Column, project: Column, default: str = DEFAULT_WORKSPACE) -> Column:
    """``workspace::project``; an already scoped project is kept."""
    plain = strip(F.coalesce(project, F.lit("")))
    prefix = F.concat(normalize_workspace(workspace, default), F.lit("::"))
    return (
        F.when(plain == "", F.concat(prefix, F.lit("default")))
        .when(plain.contains("::"), plain)
        .otherwise(F.concat(prefix, plain))
    )


def split_scoped(value: Column, fallback: Column | None = None, default: str = DEFAULT_WORKSPACE) -> Column:
    """Struct(workspace, project) of a scoped id."""
    text = strip(F.coalesce(value, F.lit("")))
    parts = F.split(text, "::", 2)
    is_scoped = text.contains("::")
    workspace = normalize_workspace(
        F.when(is_scoped, parts[0]).otherwise(fallback if fallback is not None else F.lit(None)), default
    )
    project = F.when(is_scoped, F.get(parts, 1)).otherwise(text)
    return F.struct(
        workspace.alias("workspace"),
        F.when(project == "", "default").otherwise(project).alias("project"),
    )


def project_engine(listing_paths_seen: dict[str, Column]) -> Column:
    """Engine label from marker flags, first match wins."""
    return (
        F.when(listing_paths_seen["unity"], "unity")
        .when(listing_paths_seen["unreal"], "unreal")
        .when(listing_paths_seen["node"], "node")
        .when(listing_paths_seen["python"], "python")
        .otherwise("generic")
    )

"""Per-file rows: scan columns, summaries, knowledge parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, paths, text


def describe_files(files: DataFrame) -> DataFrame:
    """Add language, module and folder to rows with a relative ``path``."""
    path = F.col("path")
    return files.withColumns(
        {
            "language": paths.language_of(path),
            "module": paths.module_of(path),
            "folder": paths.folder_of(path),
        }
    )


def extract_files(files: DataFrame) -> DataFrame:
    """Add ``dependencies`` and ``symbols`` to rows with path, language and content.

    Intermediate arrays are columns of their own, so that each regular expression runs
    once per file.
    """
    content = F.col("content")
    marked = (
        files.withColumn("_low", F.lower(F.translate(F.col("path"), "\\", "/")))
        .withColumn("_parts", extract.path_parts(F.col("_low")))
        .withColumn("_imports", extract.import_names(content))
        .withColumn("_text", extract.text_markers(F.col("_low"), F.col("language"), content))
        .withColumn("_place", extract.place_markers(F.col("_low"), F.col("_parts"), F.col("_text")))
    )
    return (
        marked.withColumn(
            "dependencies", extract.dependency_list(F.col("_imports"), F.col("_text"), F.col("_place"))
        )
        .withColumn("symbols", extract.extract_symbols(content))
        .drop("_low", "_parts", "_imports", "_text", "_place")
    )


def summarize_files(files: DataFrame) -> DataFrame:
    """Metadata and summary document of every file; drops the raw content."""
    return (
        extract_files(files)
        .withColumn("purpose", extract.infer_purpose(F.col("path"), F.col("content")))
        .withColumn(
            "summary",
            extract.file_summary(F.col("path"), F.col("purpose"), F.col("dependencies"), F.col("symbols")),
        )
        .drop("content")
    )


def parse_knowledge_files(files: DataFrame) -> DataFrame:
    """Symbols, imports, patterns, confidence, risk and summary of every file."""
    content = F.col("content")
    parsed = files.withColumns(
        {
            "line_count": text.line_count(content),
            "symbols": extract.knowledge_symbols(content),
            "dependencies": extract.knowledge_dependencies(content),
            "patterns": extract.detect_patterns(content),
        }
    )
    return parsed.withColumns(
        {
            "confidence": extract.file_confidence(
                F.col("symbols"), F.col("dependencies"), F.col("line_count")
            ),
            "risk_level": extract.file_risk(content, F.col("line_count")),
            "summary": extract.knowledge_summary(
                F.col("symbols"), F.col("dependencies"), F.col("patterns")
            ),
        }
    ).drop("content")


def project_profiles(listing: DataFrame, key: str = "project") -> DataFrame:
    """Engine and type per project from the *unfiltered* listing."""
    path = F.col("path")
    flags = listing.groupBy(key).agg(
        F.bool_or(path.startswith("Assets/")).alias("assets"),
        F.bool_or(path.startswith("ProjectSettings/")).alias("settings"),
        F.bool_or(path.rlike(r"^[^/]+\.uproject$")).alias("unreal"),
        F.bool_or(path == "package.json").alias("node"),
        F.bool_or(path.isin("requirements.txt", "pyproject.toml")).alias("python"),
    )
    engine = paths.project_engine(
        {
            "unity": F.col("assets") & F.col("settings"),
            "unreal": F.col("unreal"),
            "node": F.col("node"),
            "python": F.col("python"),
        }
    )
    kinds = {"unity": "game", "unreal": "game", "node": "service", "python": "service", "generic": "mixed"}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return flags.select(key, engine.alias("engine")).withColumn(
        "project_type", F.element_at(table, F.col("engine"))
    )


def chunk_rows(df: DataFrame, column: str, max_chars: int = 260) -> DataFrame:
    """One row per fixed-width piece, numbered from 0 (Q27)."""
    return df.select(
        *[c for c in df.columns if c != column],
        F.posexplode(text.chunk_text(F.col(column), max_chars)).alias("chunk_no", "chunk"),
    )


def marker_counts(files: DataFrame) -> DataFrame:
    """How many files carry each dependency or marker (P5-P8 in long form)."""
    return (
        extract_files(files)
        .select(F.explode("dependencies").alias("dependency"))
        .groupBy("dependency")
        .agg(F.count("*").alias("files"))
    )

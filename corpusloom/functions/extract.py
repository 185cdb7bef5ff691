"""Symbol, dependency, marker, purpose and risk extraction from file text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import stem_of
from .text import contains_any, count_present, labels_where, strip


def _matches(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def _only_with(content: Column, literal: str, found: Column) -> Column:
    """``found``, which needs ``literal`` to occur, without looking where it does not; null for a null content."""
    return F.when(~content.contains(literal), F.array().cast("array<string>")).otherwise(found)


def _sorted_set(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def import_names(content: Column) -> Column:
    """Imported names of all dependency patterns, stripped, blanks removed."""
    found = F.concat(*[_matches(content, p, g) for p, g in rules.DEPENDENCY_PATTERNS])
    return F.filter(F.transform(found, strip), lambda d: d != "")


def knowledge_dependencies(content: Column, limit: int = 30) -> Column:
    """Sorted distinct imports, first ``limit`` (P5)."""
    return F.slice(_sorted_set(import_names(content)), 1, limit)


def xml_markers(content: Column) -> Column:
    """Known tags, attribute names and bound script paths of an XML text."""
    tags = F.filter(
        F.transform(_only_with(content, "<", _matches(content, r"(?iU)<\s*([A-Za-z_][A-Za-z0-9_:-]*)\b")), F.lower),
        lambda t: t.isin(*rules.XML_TAGS),
    )
    attributes = F.transform(
        _only_with(content, "=", _matches(content, rf"(?iU)\b({'|'.join(rules.XML_ATTRIBUTES)})\s*=")), F.lower
    )
    scripts = F.filter(
        F.transform(_only_with(content, "=", _matches(content, r"""(?iU)\bscript\s*=\s*['"]([^'"]+)['"]""")), strip),
        lambda s: s != "",
    )
    return F.array_distinct(
        F.concat(
            tags,
            F.transform(tags, lambda t: F.concat(F.lit("xml-tag:"), t)),
            attributes,
            F.transform(scripts, lambda s: F.concat(F.lit("script:"), s)),
        )
    )


def lua_markers(content: Column) -> Column:
    """Constructor and callback probes plus every on* identifier longer than 3."""
    # Each pattern holds its label, so most texts need no regular expression.
    probes = labels_where(*[(content.contains(label.removesuffix("()")) & content.rlike(p), label) for label, p in rules.LUA_PROBES])
    callbacks = F.filter(_matches(content, r"(?U)\b(on[A-Za-z0-9_]+)\b"), lambda c: F.length(c) > 3)
    return F.array_distinct(F.concat(probes, callbacks))


def path_parts(low_path: Column) -> Column:
    return F.filter(F.split(low_path, "/"), lambda p: p != "")


def text_markers(low_path: Column, language: Column, content: Column) -> Column:
    """XML and Lua markers, by language or extension."""
    none = F.array().cast("array<string>")
    is_xml = (F.lower(language) == "xml") | low_path.endswith(".xml")
    is_lua = (F.lower(language) == "lua") | low_path.endswith(".lua")
    return F.concat(
        F.when(is_xml, xml_markers(content)).otherwise(none),
        F.when(is_lua, lua_markers(content)).otherwise(none),
    )


def place_markers(low_path: Column, parts: Column, text_marks: Column) -> Column:
    """Markers of a file's role, from its place in the tree and its text markers."""
    in_data = (F.size(parts) >= 2) & (F.get(parts, 0) == "data")
    system = F.get(parts, 1)
    deep_scripts = F.array_contains(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "scripts")
    runtime = low_path.startswith("data/scripts/")
    registers = F.arrays_overlap(text_marks, F.array(*map(F.lit, rules.RUNTIME_REGISTER_MARKERS)))
    bound_xml = in_data & low_path.endswith(".xml")
    return labels_where(
        (bound_xml, "classic-xml-bind"),
        (bound_xml, F.concat(F.lit("classic-"), system, F.lit("-bind"))),
        (in_data & deep_scripts, "classic-script-callback"),
        (in_data & deep_scripts, F.concat(F.lit("classic-"), system, F.lit("-script"))),
        (runtime, "runtime-script-file"),
        (runtime & registers, "runtime-script-register"),
        (F.exists(text_marks, lambda m: m.startswith("script:")), "xml-script-binding"),
        (low_path.contains("data/actions/actions.xml"), "classic-action-bind"),
        (low_path.contains("data/actions/scripts/"), "classic-action-script"),
        (low_path.contains("data/scripts/") & F.array_contains(text_marks, "Action()"), "revscripts-action"),
    )


def dependency_list(imports: Column, text_marks: Column, place_marks: Column, limit: int = 40) -> Column:
    """Imports and markers, sorted and distinct, first ``limit``."""
    return F.slice(_sorted_set(imports, text_marks, place_marks), 1, limit)


def extract_symbols(
    content: Column, patterns: Sequence[str] = rules.SYMBOL_PATTERNS, limit: int = 20
) -> Column:
    """Declared names in pattern order, then order of occurrence."""
    return F.slice(F.array_distinct(F.concat(*[_matches(content, p) for p in patterns])), 1, limit)


def knowledge_symbols(content: Column) -> Column:
    return extract_symbols(content, rules.KNOWLEDGE_SYMBOL_PATTERNS)


def infer_purpose(path: Column, content: Column) -> Column:
    """One-line purpose by ordered rules on path and text (P10)."""
    low = F.lower(content)
    where = F.lower(F.translate(path, "\\", "/"))
    parts = F.filter(F.split(where, "/"), lambda p: p != "")
    system = F.when((F.size(parts) >= 2) & (F.get(parts, 0) == "data"), F.get(parts, 1)).otherwise("script")
    say = rules.PURPOSES

    def with_system(text: str) -> Column:
        head, tail = text.split("{system}")
        return F.concat(F.lit(head), system, F.lit(tail))

    head, tail = say["default"].split("{title}")
    runtime = where.startswith("data/scripts/")
    return (
        F.when(where.endswith("data/actions/actions.xml"), say["actions_xml"])
        .when(where.contains("data/actions/scripts/") & low.contains("onuse"), say["action_script"])
        .when(
            where.contains("data/scripts/") & low.contains("action()") & low.contains(":register"),
            say["action_runtime"],
        )
        .when(
            where.startswith("data/") & where.endswith(".xml") & low.contains("script"),
            with_system(say["xml_bindings"]),
        )
        .when(
            where.startswith("data/") & ~runtime & where.contains("scripts/")
            & low.contains("on") & low.contains("function"),
            with_system(say["xml_callbacks"]),
        )
        .when(runtime & contains_any(low, (":register", "register(")), say["runtime_handlers"])
        .when(where.startswith("assets/") & where.endswith(".cs"), say["unity"])
        .when(low.contains("inventory"), say["inventory"])
        .when(contains_any(low, ("router", "endpoint")), say["api"])
        .when(contains_any(low, ("repository", "sqlite")), say["storage"])
        .otherwise(F.concat(F.lit(head), stem_of(path), F.lit(tail)))
    )


def bullet_lines(items: Column) -> Column:
    """'- item' per element, or '- none' (array of strings)."""
    return F.when(F.size(items) == 0, F.array(F.lit("- none"))).otherwise(
        F.transform(items, lambda i: F.concat(F.lit("- "), i))
    )


def file_summary(path: Column, purpose: Column, dependencies: Column, symbols: Column) -> Column:
    """Summary document of one file."""
    lines = F.concat(
        F.array(F.concat(F.lit("# "), stem_of(path)), F.lit(""), F.lit("Purpose:"), purpose,
                F.lit(""), F.lit("Dependencies:")),
        bullet_lines(dependencies),
        F.array(F.lit(""), F.lit("Core Symbols:")),
        bullet_lines(F.slice(symbols, 1, 10)),
    )
    return F.concat(strip(F.array_join(lines, "\n")), F.lit("\n"))


def detect_patterns(content: Column) -> Column:
    """Sorted architecture labels whose keywords occur."""
    low = F.lower(content)
    return F.array_sort(
        labels_where(*[(contains_any(low, keys), label) for label, keys in rules.ARCHITECTURE_PATTERNS])
    )


def file_confidence(symbols: Column, imports: Column, lines: Column) -> Column:
    """Confidence from the number of symbols, imports and lines."""
    score = (
        F.lit(0.50)
        + F.least(F.lit(0.20), F.size(symbols) * F.lit(0.02))
        + F.least(F.lit(0.12), F.size(imports) * F.lit(0.02))
        + F.when(lines > 20, 0.06).otherwise(0.0)
        + F.when(lines > 120, 0.04).otherwise(0.0)
    )
    return F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.35), score)), 2)


def file_risk(content: Column, lines: Column) -> Column:
    """low / medium / high from length and debt words."""
    score = F.when(lines > 500, 2).when(lines > 220, 1).otherwise(0) + count_present(
        F.lower(content), rules.DEBT_WORDS
    )
    return F.when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")


def knowledge_summary(symbols: Column, imports: Column, patterns: Column) -> Column:
    """Summary text of a knowledge file node."""

    def section(title: str, items: Column) -> Column:
        return F.when(F.size(items) == 0, F.array().cast("array<string>")).otherwise(
            F.concat(F.array(F.lit(title)), bullet_lines(items))
        )

    return F.array_join(
        F.concat(
            F.array(
                F.lit("Responsibilities:"),
                F.lit("- preserve source intent and API boundaries"),
                F.lit("- expose coherent behavior for this unit"),
            ),
            section("Core Symbols:", F.slice(symbols, 1, 6)),
            section("Dependencies:", F.slice(imports, 1, 8)),
            section("Detected Patterns:", patterns),
        ),
        "\n",
    )

"""Prompt features, path bonuses, freshness, cosine and final scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .paths import suffix_of, wrapped
from .text import contains_any


def detect_intent(prompt: Column) -> Column:
    """First matching intent of the prompt (Q1)."""
    low = F.lower(prompt)
    chain = None
    for intent, words in rules.INTENTS:
        cond = contains_any(low, words)
        chain = F.when(cond, intent) if chain is None else chain.when(cond, intent)
    return chain.otherwise(rules.DEFAULT_INTENT)


def freshness(modified_at: Column, now: Column) -> Column:
    """Step score of the age in days; .55 when unknown (Q4)."""
    age = F.greatest(F.lit(0), F.unix_micros(now) - F.unix_micros(modified_at)) / F.lit(86400e6)
    return (
        F.when(modified_at.isNull(), 0.55)
        .when(age <= 1, 1.0)
        .when(age <= 7, 0.85)
        .when(age <= 30, 0.70)
        .when(age <= 90, 0.55)
        .otherwise(0.40)
    )


def xml_terms(prompt: Column) -> Column:
    """Stems of the XML file names a prompt mentions (Q12)."""
    found = F.regexp_extract_all(F.lower(prompt), F.lit(r"([a-z0-9_\-]+)\.xml"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def is_xml_focus(prompt: Column) -> Column:
    low = F.lower(prompt)
    return low.contains(".xml") | low.contains(" xml") | low.startswith("xml")


def is_loot_focus(prompt: Column) -> Column:
    low = F.lower(prompt)
    item_and_drop = contains_any(low, rules.LOOT_ITEM_WORDS) & contains_any(low, rules.LOOT_DROP_WORDS)
    return low.contains("items.xml") | contains_any(low, rules.LOOT_TERMS) | item_and_drop


def prompt_features(prompt: Column) -> dict[str, Column]:
    """Boolean features of a prompt that switch path-bonus rules (Q5)."""
    low = F.lower(prompt)
    classic = contains_any(low, rules.CLASSIC_SCRIPT_TERMS)
    runtime = contains_any(low, rules.RUNTIME_SCRIPT_TERMS)
    action_words = rules.ACTION_XML_TERMS + rules.ACTION_RUNTIME_TERMS + rules.ACTION_BIND_TERMS
    return {
        "no_tooling": ~contains_any(low, rules.TOOLING_TERMS),
        "architecture": contains_any(low, rules.ARCHITECTURE_TERMS) | classic | runtime,
        "classic": classic,
        "runtime": runtime,
        "action": contains_any(low, action_words),
        "action_runtime": contains_any(low, rules.ACTION_RUNTIME_TERMS),
        "xml": low.contains("xml") | contains_any(low, rules.ACTION_XML_TERMS + rules.CLASSIC_SCRIPT_TERMS),
        "npc": low.contains("npc"),
        "spell": low.contains("spell"),
        "quest": low.contains("quest"),
        "loot": is_loot_focus(prompt),
    }


def path_features(path: Column) -> dict[str, Column]:
    """Boolean features of a path that path-bonus rules and profiles look at (Q5)."""
    norm = wrapped(path)
    ext = suffix_of(F.btrim(norm, F.lit("/")))
    in_scripts = norm.contains("/scripts/")
    items_xml = norm.endswith("/data/items/items.xml/")
    return {
        "in_src": norm.contains("/src/"),
        "in_app": norm.contains("/app/"),
        "in_assets": norm.contains("/assets/"),
        "in_scripts": in_scripts,
        "in_data_scripts": norm.contains("/data/scripts/"),
        "in_binding_dir": contains_any(norm, rules.BINDING_DIRS),
        "main_code_ext": ext.isin(".cs", ".cpp", ".h", ".hpp", ".lua", ".ts", ".tsx", ".js", ".py"),
        "in_low_signal": contains_any(norm, rules.LOW_SIGNAL_DIRS),
        "in_tools": norm.contains("/data/tools/") | norm.startswith("/tools/"),
        "core_source": contains_any(norm, rules.CORE_SOURCE_HINTS),
        "in_scripts_or_assets": in_scripts | norm.contains("/assets/"),
        "xml_ext": ext == ".xml",
        "xml_file": norm.endswith(".xml/"),
        "scripts_code": in_scripts & ext.isin(".lua", ".cs", ".ts", ".tsx", ".js", ".py"),
        "actions_xml": norm.contains("/data/actions/actions.xml/"),
        "in_action_scripts": norm.contains("/data/actions/scripts/"),
        "src_actions": norm.contains("/src/actions"),
        "src_luascript": norm.contains("/src/luascript"),
        "src_baseevents": norm.contains("/src/baseevents"),
        "src_scriptmanager": norm.contains("/src/scriptmanager"),
        "src_script": norm.contains("/src/script"),
        "npc_path": contains_any(norm, ("/data/scripts/", "/src/npc")),
        "spell_path": contains_any(norm, ("/data/spells/", "/src/spells")),
        "quest_path": norm.contains("/src/quests"),
        "items_xml": items_xml,
        "other_items_xml": ~items_xml & norm.contains("/data/items/") & (ext == ".xml"),
        "monster_xml": contains_any(norm, ("/data/monster/", "/data/monsters/")) & (ext == ".xml"),
        "in_loot": norm.contains("/loot/"),
        "loot_script": norm.contains("/data/scripts/") & contains_any(norm, ("loot", "drop")),
        "shader_ext": ext.isin(".shader", ".shadergraph", ".shadersubgraph", ".hlsl"),
        "network_path": contains_any(norm, ("/network", "protocol", "opcode", "packet")),
    }


_PROMPT_FEATURES = (
    "no_tooling", "architecture", "classic", "runtime", "action", "action_runtime", "xml", "npc", "spell",
    "quest", "loot",
)
_PATH_FEATURES = (
    "in_src", "in_app", "in_assets", "in_scripts", "in_data_scripts", "in_binding_dir", "main_code_ext",
    "in_low_signal", "in_tools", "core_source", "in_scripts_or_assets", "xml_ext", "xml_file", "scripts_code",
    "actions_xml", "in_action_scripts", "src_actions", "src_luascript", "src_baseevents", "src_scriptmanager",
    "src_script", "npc_path", "spell_path", "quest_path", "items_xml", "other_items_xml", "monster_xml",
    "in_loot", "loot_script", "shader_ext", "network_path",
)


def _bits(features: dict[str, Column], order: tuple[str, ...]) -> Column:
    """Features as one long, so that pairs and classes carry a single column."""
    total = F.lit(0).cast("long")
    for place, name in enumerate(order):
        total = total + F.when(features[name], 1 << place).otherwise(0)
    return total


def _has(bits: str, order: tuple[str, ...], name: str) -> Column:
    return F.col(bits).bitwiseAND(F.lit(1 << order.index(name)).cast("long")) != 0


def with_prompt_features(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Add the prompt features, once per request rather than once per pair."""
    col = F.col(prompt)
    return requests.withColumns(
        {
            "p_bits": _bits(prompt_features(col), _PROMPT_FEATURES),
            "p_xml_terms": xml_terms(col),
            "xml_focus": is_xml_focus(col),
            "loot_focus": is_loot_focus(col),
        }
    )


def with_path_features(corpus: DataFrame, path: str = "path") -> DataFrame:
    """Add the path features, once per document rather than once per pair."""
    return corpus.withColumns(
        {"d_bits": _bits(path_features(F.col(path)), _PATH_FEATURES), "d_norm": wrapped(F.col(path))}
    )


def path_bonus() -> Column:
    """Importance bonus of a (request, document) pair carrying both feature sets (Q5)."""
    named = F.exists(
        F.col("p_xml_terms"),
        lambda t: F.contains(F.col("d_norm"), F.concat(F.lit("/"), t, F.lit(".xml/"))),
    )
    total = F.lit(0.0)
    for prompt_feature, path_feature, weight in rules.PATH_BONUS:
        if path_feature == "named_xml":
            cond = _has("d_bits", _PATH_FEATURES, "xml_file") & named
        else:
            cond = _has("d_bits", _PATH_FEATURES, path_feature)
        if prompt_feature is not None:
            cond = _has("p_bits", _PROMPT_FEATURES, prompt_feature) & cond
        total = total + F.when(cond, weight).otherwise(0.0)
    profile = {
        "xml": "xml_ext", "scripts": "in_scripts", "assets": "in_assets", "src": "in_src",
        "shader": "shader_ext", "networking": "network_path",
    }
    for boost, feature in profile.items():
        cond = _has("d_bits", _PATH_FEATURES, feature)
        total = total + F.when(cond, F.col(f"{boost}_boost")).otherwise(0.0)
    return total


def active_profiles(workspace: Column, prompt: Column) -> dict[str, Column]:
    """Which calibration profiles a request activates, in their fixed order (Q6)."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    ws = F.lower(F.coalesce(workspace, F.lit("")))
    return {
        "unity_profile": ws.contains("unity"),
        "mmo_profile": ws.contains("mmo") & ~ws.contains("unity"),
        "networking_profile": contains_any(low, rules.NETWORK_WORDS),
        "lua_profile": contains_any(low, rules.LUA_WORDS),
        "shader_profile": contains_any(low, rules.SHADER_WORDS),
        "xml_profile": is_xml_focus(low),
    }


def with_profile(
    requests: DataFrame, workspace: str = "workspace_id", prompt: str = "prompt", profiles=rules.PROFILES
) -> DataFrame:
    """Add profile_name and the six summed *_boost columns (Q6).

    The profile table is a short fixed list, so it unrolls into column arithmetic and
    needs no join.
    """
    active = active_profiles(F.col(workspace), F.col(prompt))
    names = F.array_compact(F.array(*[F.when(active[p[0]], p[0]) for p in profiles]))
    boosts = []
    for i, boost in enumerate(rules.PROFILE_COLUMNS[1:], start=1):
        total = F.lit(0.0)
        for p in profiles:
            if p[i]:
                total = total + F.when(active[p[0]], p[i]).otherwise(0.0)
        boosts.append(total.alias(f"{boost}_boost"))
    name = F.when(F.size(names) == 0, "default").otherwise(F.array_join(names, "+"))
    return requests.select("*", name.alias("profile_name"), *boosts)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def artifact_importance(n_deps: Column, bonus: Column) -> Column:
    """Importance of an artifact from its dependencies and path bonus (Q7)."""
    return clip(F.lit(0.50) + F.least(F.lit(0.45), n_deps * F.lit(0.04)) + bonus, 0.05, 1.0)


def artifact_confidence(confidence: Column) -> Column:
    return clip(F.coalesce(confidence, F.lit(0.78)), 0.3, 1.0)


def memory_importance(scope: Column) -> Column:
    """Project memories weigh more than the others (Q8)."""
    return F.when(scope == "project", 0.65).otherwise(0.55)


def knowledge_importance(n_deps: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.60) + F.least(F.lit(0.30), n_deps * F.lit(0.03)))


def blended_relevance(relevance: Column, semantic: Column) -> Column:
    """Lexical relevance, mixed with the semantic score where there is one (Q9)."""
    mixed = clip(F.round(relevance * 0.45 + semantic * 0.55, 4), 0.0, 1.0)
    return F.when(semantic > 0, mixed).otherwise(relevance)


def final_score(blended: Column, fresh: Column, confidence: Column, importance: Column) -> Column:
    """Weighted score in [0, 1], four digits (Q9)."""
    weighted = blended * 0.50 + fresh * 0.15 + confidence * 0.20 + importance * 0.15
    return clip(F.round(weighted, 4), 0.0, 1.0)


def cosine01(left: Column, right: Column) -> Column:
    """(cosine + 1) / 2 to four digits; 0 for empty, unequal or zero vectors (Q10)."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    usable = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (norms > 0)
    value = clip(F.round((dot(left, right) / norms + 1.0) / 2.0, 4), 0.0, 1.0)
    return F.when(F.coalesce(usable, F.lit(False)), value).otherwise(0.0)


def embedding_text(source: Column, dependencies: Column, content: Column) -> Column:
    """Text handed to an embedding model for one candidate (Q11)."""
    body = F.btrim(F.translate(F.substr(content, F.lit(1), F.lit(900)), "\n", " "))
    return F.concat(
        F.lit("source="), source, F.lit(";deps="), F.array_join(F.slice(dependencies, 1, 20), ", "),
        F.lit(";content="), body,
    )


def is_xml_artifact(source: Column) -> Column:
    return source.startswith("artifact:file:") & F.lower(source).endswith(".xml")


def is_items_xml(source: Column) -> Column:
    low = F.lower(F.translate(source, "\\", "/"))
    return source.startswith("artifact:file:") & (low == "artifact:file:data/items/items.xml")


def is_loot_artifact(source: Column) -> Column:
    """Item tables, loot folders, monster tables and loot scripts (Q12)."""
    low = F.lower(F.translate(source, "\\", "/"))
    xml = low.endswith(".xml")
    return source.startswith("artifact:file:") & (
        is_items_xml(source)
        | (low.contains("/data/items/") & xml)
        | low.contains("/loot/")
        | (contains_any(low, ("/data/monster/", "/data/monsters/")) & xml)
        | (low.contains("/data/scripts/") & contains_any(low, ("loot", "drop")))
    )


def names_xml(source: Column, terms: Column) -> Column:
    """An XML artifact whose file name the prompt mentions (Q12)."""
    low = F.lower(source)
    hit = F.exists(terms, lambda t: F.contains(low, F.concat(F.lit("/"), t, F.lit(".xml"))))
    return is_xml_artifact(source) & hit


# Bits of a candidate's artifact flags.
XML_FLAG, NAMED_XML_FLAG, ITEMS_XML_FLAG, LOOT_FLAG = 1, 2, 4, 8


def artifact_flags(source: Column, terms: Column) -> Column:
    """Which required-artifact roles a candidate can fill (Q12)."""
    roles = {
        XML_FLAG: is_xml_artifact(source), NAMED_XML_FLAG: names_xml(source, terms),
        ITEMS_XML_FLAG: is_items_xml(source), LOOT_FLAG: is_loot_artifact(source),
    }
    total = F.lit(0)
    for bit, cond in roles.items():
        total = total + F.when(cond, bit).otherwise(0)
    return total


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0

"""Chat formatting with schema fingerprints, in DataFrame functions only.

Training data comes in many layouts: one row a turn, a list of messages, an instruction with an input, a prompt with an answer.  A
record of any layout is held as a variant.  The nested paths of its fields are read from its own schema, those that a mapping
names are sorted and hashed, and the hash selects the declarative mapping that turns the record into canonical turns (role, text).
Fields that no mapping names do not disturb the hash.  A new layout is a new line in ``MAPPINGS``; no code changes.

The template marks a turn as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a line feed.  Inside texts every ``<``
followed by backslashes and ``|`` gets one backslash more, so no text holds a control string and the change can be undone; in roles
``%``, ``<`` and line feeds are percent-encoded.  The output of a conversation is a list of segments (text, loss): their
concatenation is the formatted text, and ``loss`` is the mask, true for the texts of assistants alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``required`` and ``optional`` are field paths; ``a.b`` is a field of a field and ``[]`` stands for the elements of a list.  A turn of
    ``flat`` is (role, paths): the texts found there are joined by an empty line, and a role that starts with ``$.`` is a path itself.
    ``lists`` are (list, role field, text field).  ``roles`` renames roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    lists: tuple[tuple[str, str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def signatures(self) -> list[str]:
        """The sorted paths of every record that this mapping takes."""
        return [
            "\n".join(sorted({*self.required, *chosen}))
            for n in range(len(self.optional) + 1)
            for chosen in combinations(self.optional, n)
        ]


_SHARED_ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}

MAPPINGS = (
    Mapping("turn", ("role", "text"), flat=(("$.role", ("text",)),)),
    Mapping("turn content", ("content", "role"), flat=(("$.role", ("content",)),)),
    Mapping("messages", ("messages[].content", "messages[].role"), lists=(("messages", "role", "content"),)),
    Mapping("no messages", ("messages[] (empty)",), lists=(("messages", "role", "content"),)),
    Mapping(
        "shared conversation", ("conversations[].from", "conversations[].value"), ("system",), flat=(("system", ("system",)),),
        lists=(("conversations", "from", "value"),), roles=_SHARED_ROLES,
    ),
    Mapping(
        "instruction", ("instruction", "output"), ("input", "system"),
        flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping("prompt and response", ("prompt", "response"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", ("prompt", "completion"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question and answer", ("question", "answer"), ("context",), flat=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Mapping("nested question", ("data.question", "data.answer"), flat=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
    Mapping(
        "prompt and completion messages", ("prompt[].content", "prompt[].role", "completion[].content", "completion[].role"),
        lists=(("prompt", "role", "content"), ("completion", "role", "content")),
    ),
)


def field_paths(record: Column) -> Column:
    """The paths of all leaves of a variant, sorted and distinct, read from its schema; null for null.

    The schema is a nested text such as ``OBJECT<messages: ARRAY<OBJECT<role: STRING>>>``; a fold over its tokens keeps the open
    prefixes on a stack.  Lists of differing elements give the paths of all of them; a place that holds values of differing types is
    marked as mixed and a list without elements as empty, so that no mapping takes them for plain texts.
    """
    tokens = F.regexp_extract_all(
        F.schema_of_variant(record), F.lit(r"(?:`(?:[^`]|``)*`|[^`<>:, ]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"), F.lit(0)
    )
    text = "cast('' as string)"
    start = F.expr(f"named_struct('open', cast(array() as array<string>), 'at', {text}, 'paths', cast(array() as array<string>))")

    def step(state: Column, token: Column) -> Column:
        is_open, at, paths = state["open"], state["at"], state["paths"]
        key = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        outer = F.element_at(is_open, -1)
        named = F.struct(is_open.alias("open"), F.when(outer == "", key).otherwise(F.concat(outer, F.lit("."), key)).alias("at"), paths.alias("paths"))
        into = F.when(token == "ARRAY<", F.concat(at, F.lit("[]"))).otherwise(at)
        opened = F.struct(F.array_append(is_open, into).alias("open"), into.alias("at"), paths.alias("paths"))
        closed = F.struct(F.slice(is_open, 1, F.size(is_open) - 1).alias("open"), at.alias("at"), paths.alias("paths"))
        ending = F.when(token == "VARIANT", F.lit(" (mixed)")).when((token == "VOID") & at.endswith("[]"), F.lit(" (empty)")).otherwise(F.lit(""))
        leaf = F.struct(is_open.alias("open"), at.alias("at"), F.array_append(paths, F.concat(at, ending)).alias("paths"))
        return (
            F.when(token.endswith(": "), named).when(token.isin("OBJECT<", "ARRAY<"), opened).when(token == ">", closed).otherwise(leaf)
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda state: state["paths"])))


def fingerprint(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The hash of the field paths that some mapping names."""
    known = sorted({path for m in mappings for path in (*m.required, *m.optional)})
    return F.xxhash64(F.array_join(F.array_intersect(field_paths(record), F.array(*map(F.lit, known))), "\n"))


def _layout(print_: Column, mappings: tuple[Mapping, ...]) -> Column:
    by_print = [x for m in mappings for s in m.signatures() for x in (F.xxhash64(F.lit(s)), F.lit(m.name))]
    return F.try_element_at(F.create_map(*by_print), print_)


def _mapped(record: Column, mapping: Mapping) -> Column:
    def read(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(record, f"$.{path}", kind)

    def renamed(role: Column) -> Column:
        if not mapping.roles:
            return role
        names = F.create_map(*[F.lit(x) for pair in mapping.roles.items() for x in pair])
        return F.coalesce(F.try_element_at(names, role), role)

    def message(role: str, text: str):
        return lambda x: F.struct(F.coalesce(renamed(x[role]), F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    parts = []
    for role, paths in mapping.flat:
        texts = F.concat_ws("\n\n", *[F.when(read(p) != "", read(p)) for p in paths]) if len(paths) > 1 else F.coalesce(read(paths[0]), F.lit(""))
        name = F.coalesce(renamed(read(role[2:])), F.lit("")) if role.startswith("$.") else F.lit(role)
        turn = F.array(F.struct(name.alias("role"), texts.alias("text")))
        missing = set(paths) <= set(mapping.optional)
        parts.append(F.when(read(paths[0]).isNotNull(), turn).otherwise(F.expr(f"cast(array() as {_TURNS})")) if missing else turn)
    for path, role, text in mapping.lists:
        kind = f"array<struct<`{role}`:string,`{text}`:string>>"
        found = F.coalesce(read(path, kind), F.expr(f"cast(array() as {kind})"))
        parts.append(F.transform(found, message(role, text)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical_turns(rows: DataFrame, record: Column, *keep: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(keep..., layout, turns): every record's layout and its turns (role, text).

    ``record`` is a variant: ``F.try_parse_json`` of a text or ``F.to_variant_object`` of a struct.  A null or unreadable record and one
    whose fingerprint no mapping has keep their row with a null layout and no turns.  Null roles and texts are empty.  Only the
    columns in ``keep`` are returned, so no other column can clash.
    """
    held = rows.select(*[F.col(f"`{c}`") for c in keep], record.alias("__record"))
    marked = held.withColumn("layout", _layout(fingerprint(F.col("__record"), mappings), mappings))
    turns = F.expr(f"cast(array() as {_TURNS})")
    for mapping in mappings:
        turns = F.when(F.col("layout") == mapping.name, _mapped(F.col("__record"), mapping)).otherwise(turns)
    return marked.select(*[F.col(f"`{c}`") for c in keep], "layout", turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments(turns: Column) -> Column:
    """The formatted text of a list of turns as segments (text, loss)."""

    def marked(turn: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(START), _escaped_role(turn["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn["text"]).alias("text"), (turn["role"] == TRAINED_ROLE).alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, marked))


def formatted_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        at = F.locate("\n", piece)
        return F.struct(
            _unescaped_role(F.substring(piece, F.lit(len(START) + 1), at - len(START) - 1)).alias("role"),
            unescaped(F.substring(piece, at + 1, F.length(piece))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def format_conversations(rows: DataFrame, key: str, order: str, record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per conversation: (key, segments).

    Rows of one key are one conversation, by ``order``, nulls first; rows that tie go by their roles and texts, and rows that repeat are
    turns of their own.  A null key is a conversation like any other.  Rows without a known layout add no turn, but their conversation
    stays.  The rows are mapped where they are read; only canonical turns are shuffled.  A conversation is one training example and
    one row, so it must fit Spark's 2 GB of a value.  An empty table gives no rows.
    """
    named = rows.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{order}`").alias("__order"), record.alias("__of"))
    turns = canonical_turns(named, F.col("__of"), "__key", "__order", mappings=mappings)
    together = turns.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__order", "turns"))).alias("rows"))
    return together.select(F.col("__key").alias(key), segments(F.flatten(F.transform("rows", lambda r: r["turns"]))).alias("segments"))

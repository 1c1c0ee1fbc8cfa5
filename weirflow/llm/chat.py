r"""Chat formatting by schema fingerprints.

A record layout is recognised by its fingerprint, the hash of its sorted nested
field paths, and the fingerprint selects a declarative mapping (one SQL expression)
to canonical turns ``array<struct<role, text>>``. Typed tables are fingerprinted once
from their schema; JSON records row by row from their variant schema.

The template writes each turn as ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles
and texts every control string of ``CONTROL`` is broken by a backslash after its first
character; one that is already broken by k backslashes gets k + 1, so taking one away
restores the text exactly. In roles a newline is written ``\n`` and a backslash ``\\``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"
#: First characters and rests of the control strings that texts must not hold.
CONTROL = r"(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>)|(\[)(\\*)(/?INST\])"
BROKEN = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, BROKEN, r"$1$4$2$5$3$6")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # doubled backslashes are cut out first, from the left, so what is left holds single ones only
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of a type, arrays as ``[]``, leaves with nothing but their place."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}")] or [prefix]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, prefix + "{}")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    """MD5 of the sorted paths, one a line, in hex; ``F.md5`` makes the same of a layout's column."""
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


def one(role: str, field: str) -> str:
    return f"named_struct('role', '{role}', 'text', coalesce({field}, ''))"


def optional(role: str, field: str) -> str:
    return f"if(coalesce({field}, '') = '', array(), array({one(role, field)}))"


#: Layouts of one record a conversation: its field paths, a schema to read it by, its turns.
LAYOUTS = [
    (".messages[].role .messages[].content", "messages array<struct<role:string,content:string>>",
     "transform(coalesce(r.messages, array()), m -> named_struct('role', coalesce(m.role, ''), 'text', coalesce(m.content, '')))"),
    (".conversations[].from .conversations[].value", "conversations array<struct<`from`:string,value:string>>",
     "transform(coalesce(r.conversations, array()), m -> named_struct('role', case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else coalesce(m.`from`, '') end, 'text', coalesce(m.value, '')))"),
    (".messages[]", "messages array<string>", f"cast(array() as {TURNS})"),  # empty lists have no fields
    (".conversations[]", "conversations array<string>", f"cast(array() as {TURNS})"),
    (".prompt .response", "prompt string, response string", f"array({one('user', 'r.prompt')}, {one('assistant', 'r.response')})"),
    (".prompt .completion", "prompt string, completion string", f"array({one('user', 'r.prompt')}, {one('assistant', 'r.completion')})"),
    (".question .answer", "question string, answer string", f"array({one('user', 'r.question')}, {one('assistant', 'r.answer')})"),
    (".instruction .output", "instruction string, output string", f"array({one('user', 'r.instruction')}, {one('assistant', 'r.output')})"),
    (".instruction .input .output", "instruction string, input string, output string",
     "array(named_struct('role', 'user', 'text', concat(coalesce(r.instruction, ''), if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input)))), "
     + one("assistant", "r.output") + ")"),
    (".system .prompt .response", "system string, prompt string, response string",
     f"concat({optional('system', 'r.system')}, array({one('user', 'r.prompt')}, {one('assistant', 'r.response')}))"),
]
MAPPINGS = {fingerprint(paths.split()): (schema, turns) for paths, schema, turns in LAYOUTS}
#: Columns and layout of one row a turn.
TURN_COLUMNS = ("conv_id", "turn", "role", "text")
TURN_ROWS = fingerprint(f".{c}" for c in TURN_COLUMNS)


def json_fingerprint_paths(json: Column) -> Column:
    """Sorted nested paths of one JSON record, from its variant schema, joined by newlines.

    ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>`` gives ``.a[].b``: names directly under
    another object are prefixed by walking the schema text once, token by token.
    """
    schema = F.schema_of_variant(F.try_parse_json(json))
    tokens = F.regexp_extract_all(schema, F.lit(r"(`[^`]+`|[A-Za-z_0-9]+): |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9,]+\))?"), F.lit(0))
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths")
    )

    def step(a: Column, t: Column) -> Column:
        stack, at, paths = a["stack"], a["at"], a["paths"]
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))
        state = lambda s, x, p: F.struct(s.alias("stack"), x.alias("at"), p.alias("paths"))
        return (
            F.when(t == "OBJECT<", state(F.concat(stack, F.array(at)), at, paths))
            .when(t == "ARRAY<", state(F.concat(stack, F.array(F.concat(at, F.lit("[]")))), F.concat(at, F.lit("[]")), paths))
            .when(t == ">", state(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))), top, paths))
            .when(t.endswith(": "), state(stack, F.concat(top, F.lit("."), F.lower(F.translate(F.regexp_replace(t, ": $", ""), "`", ""))), paths))
            .otherwise(state(stack, at, F.concat(paths, F.array(at))))
        )

    return F.array_join(F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda a: a["paths"]))), "\n")


def turns_of_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``conv_id, turns, layout`` of JSON records in any mix of the known layouts.

    ``layout`` is the sorted field paths; records of an unknown layout, or that are
    null or no JSON object, keep their row with null turns.
    """
    paths = json_fingerprint_paths(F.col(json_col))
    turns = F.lit(None).cast(TURNS)
    r = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("json"), paths.alias("layout"))
    found = F.md5(F.col("layout"))
    for known, (schema, mapping) in MAPPINGS.items():
        turns = F.when(F.col("found") == known, F.expr(f"transform(array(from_json(json, '{schema}')), r -> {mapping})[0]").cast(TURNS)).otherwise(turns)
    return r.withColumn("found", found).select("conv_id", turns.alias("turns"), "layout")


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` of a table with one row a turn, ordered by turn, then role and text."""
    r = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return r.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")
    )


def canonical_turns(df: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """Choose the mapping of a table by the fingerprint of its schema and return ``conv_id, turns``.

    Known are one row a turn (``conv_id, turn, role, text``; further columns are
    ignored), typed records in one of ``LAYOUTS`` beside ``id_col``, and JSON strings in
    ``json_col``. Another schema raises ``ValueError``.
    """
    names = {f.name.lower() for f in df.schema.fields}
    if fingerprint(field_paths(T.StructType([f for f in df.schema.fields if f.name.lower() in TURN_COLUMNS]))) == TURN_ROWS:
        return turns_of_rows(df)
    rest = T.StructType([f for f in df.schema.fields if f.name.lower() != id_col.lower()])
    found = MAPPINGS.get(fingerprint(field_paths(rest)))
    if found:
        fields = F.struct(*[F.col(f"`{f.name}`") for f in rest.fields])
        return df.select(F.col(id_col).alias("conv_id"), F.array(fields).alias("rs")).select(
            "conv_id", F.expr(f"transform(rs, r -> {found[1]})[0]").cast(TURNS).alias("turns")
        )
    if json_col.lower() in names:
        return turns_of_json(df, id_col, json_col).select("conv_id", "turns")
    raise ValueError(f"no mapping for the layout {sorted(field_paths(rest))}")


def format_chat(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, segments`` of ``conv_id, turns``.

    ``segments`` (array of ``text, loss``) are the pieces of ``formatted`` in order; the
    loss mask covers the escaped texts of turns whose role is ``learn``. An empty array
    gives an empty string without segments; null turns, which a record of unknown layout
    has, raise an error that names the conversation. A null role or text counts as empty.
    """

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n"))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(head, F.lit(False)),
            piece(escape(F.coalesce(t["text"], F.lit(""))), F.coalesce(t["role"] == learn, F.lit(False))),
            piece(F.lit(END + "\n"), F.lit(False)),
        )

    unknown = F.raise_error(F.concat(F.lit("no turns, as of a record of unknown layout: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    known = F.when(F.col("turns").isNull(), unknown.cast(TURNS)).otherwise(F.col("turns"))
    s = turns.select("conv_id", F.flatten(F.transform(known, pieces)).alias("segments"))
    return s.select("conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars``: the turns parsed from ``formatted`` alone, and the unescaped text under the mask."""
    ends = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(ends, F.lit(1), F.size(ends) - 1)

    def parse(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = F.substring(p, F.lit(len(START) + 1), cut - len(START) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(p, cut + 1)).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    return formatted.select("conv_id", F.transform(parts, parse).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))

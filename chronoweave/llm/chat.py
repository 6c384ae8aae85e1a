"""Chat formatting, native: layouts told by their field paths, made into canonical turns and a marked text.

A layout's fingerprint is the SHA-256 of its sorted nested field paths, such as ``messages[].role``. A table's
fingerprint over the known paths picks a declared mapping; so does, for each row, that of a JSON text. The template
puts a start mark with the role, the text and an end mark for each turn. Control strings start with ``<|``; inside
texts and roles a word joiner follows each ``<``, so no control string can occur there, and taking one joiner away
after each ``<`` gives the text back exactly. The loss mask lists spans of code points: the assistants' texts.

Defined cases: null text counts as empty, null role as an empty role; turns are ordered by turn, then role, then
text, null turns first; repeated rows are turns of their own; rows with a null conversation id are one
conversation; rows of no known layout have no turns; an empty table gives an empty result; other columns are not
read. A conversation's text must fit in a task's memory, as its digest is of the whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, END, JOINER, TRAINED = "<|im_start|>", "<|im_end|>", "\u2060", "assistant"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"

#: Declared layouts: the field paths, and the turns as (role or the field that has it, field of the text).
LAYOUTS: dict[str, dict] = {
    "turns": {"paths": ("role", "text", "turn"), "rows": ("turn", "role", "text")},
    "messages": {"paths": ("messages[].content", "messages[].role"), "each": ("messages", "role", "content")},
    "shared": {"paths": ("conversations[].from", "conversations[].value"), "each": ("conversations", "from", "value")},
    "response": {"paths": ("prompt", "response"), "fixed": (("user", ("prompt",)), ("assistant", ("response",)))},
    "completion": {"paths": ("completion", "prompt"), "fixed": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "instruction": {"paths": ("input", "instruction", "output"), "fixed": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "instruction_only": {"paths": ("instruction", "output"), "fixed": (("user", ("instruction",)), ("assistant", ("output",)))},
    "system_prompt": {"paths": ("prompt", "response", "system"), "fixed": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
}
#: Other names of the same roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
JSON = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, response string, completion string, instruction string, input string, output string, system string"


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """The sorted paths of all leaf fields."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    """SHA-256 of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_PRINT = {fingerprint(x["paths"]): name for name, x in LAYOUTS.items()}
KNOWN = {p for x in LAYOUTS.values() for p in x["paths"]}


def layout_of(df: DataFrame, id_col: str) -> str:
    """The layout by the fingerprint over known paths; else the one with the most paths that are all there."""
    own = {p for p in paths_of(df.schema) if p in KNOWN and p != id_col}
    if name := BY_PRINT.get(fingerprint(own)):
        return name
    inside = [name for name, x in LAYOUTS.items() if set(x["paths"]) <= own]
    if not inside:
        raise ValueError(f"no declared layout has fields among {sorted(own)}")
    return max(inside, key=lambda name: (len(LAYOUTS[name]["paths"]), name))


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(names[role], role)


def _mapped(name: str, field) -> Column:
    """The turns of a row by a layout's mapping; ``field`` gives a column for a field's name."""
    spec = LAYOUTS[name]
    if "each" in spec:
        many, role, text = spec["each"]
        turns = F.transform(field(many), lambda x, i: F.struct(i.cast("bigint").alias("turn"), _role(x[role].cast("string")).alias("role"), x[text].cast("string").alias("text")))
    else:
        said = [(i, role, F.concat_ws("\n", *[F.nullif(field(x).cast("string"), F.lit("")) for x in texts])) for i, (role, texts) in enumerate(spec["fixed"])]
        turns = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), text.alias("text")) for i, role, text in said])
    return turns.cast(TURNS)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text: one row for each turn, from a table in any declared layout."""
    name = layout_of(df, id_col)
    if name == "turns":
        turn, role, text = LAYOUTS[name]["rows"]
        return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.inline(_mapped(name, lambda f: F.col(f"`{f}`"))))


def _json_print(value: Column) -> Column:
    """The fingerprint of one JSON object, from its variant schema: its paths in the order of their names."""
    shape = F.regexp_replace(F.schema_of_variant(value), r"\b(?:VOID|BIGINT|BOOLEAN|DOUBLE|DECIMAL\(\d+,\d+\))", "STRING")
    inner = F.regexp_replace(shape, r"(\w+): ARRAY<OBJECT<(\w+): STRING, (\w+): STRING>>", r"$1[].$2, $1[].$3")
    return F.sha2(F.replace(F.regexp_replace(F.regexp_replace(inner, r"^OBJECT<|>$", ""), ": STRING", ""), F.lit(", "), F.lit("\n")), 256)


def json_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Like canonical_turns(), from JSON texts of mixed layouts. Broken or unknown ones have no turns."""
    own = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).cast("string").alias("json"))
    own = own.select("conv_id", _json_print(F.try_parse_json("json")).alias("print"), F.from_json("json", JSON).alias("row"))
    turns = F.array().cast(TURNS)
    for name, spec in LAYOUTS.items():
        if "rows" not in spec:
            turns = F.when(F.col("print") == fingerprint(spec["paths"]), _mapped(name, lambda f: F.col("row")[f])).otherwise(turns)
    return own.select("conv_id", F.inline(turns))


def escaped(text: Column) -> Column:
    """No control string can occur in it."""
    return F.replace(text, F.lit("<"), F.lit("<" + JOINER))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<" + JOINER), F.lit("<"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (start and length of spans, in code points) from rows of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("<n>")), F.lit("\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(size.cast("long")).over(order))
    begin = F.col("end") - size + F.length("head")
    part = F.struct("end", (F.col("role") == TRAINED).alias("trained"), begin.alias("start"), F.length("body").cast("long").alias("length"), F.concat("head", "body", F.lit(END + "\n")).alias("part"))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    mask = F.transform(F.filter("parts", lambda p: p.trained), lambda p: F.struct(p.start.alias("start"), p.length.alias("length")))
    return made.select("conv_id", F.array_join(F.transform("parts", lambda p: p.part), "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescaped(F.replace(role, F.lit("<n>"), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(formatted, (m.start + 1).cast("int"), m.length.cast("int")))), "")

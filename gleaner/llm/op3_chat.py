r"""Operator 3 [native]: chat formatting with schema fingerprints.

Heterogeneous layouts become canonical turns through declarative mappings.  The
nested field paths of a record (``messages[].role`` and so on) are hashed against each
known layout: the paths found, as far as the layout names them, are sorted and hashed, and
the largest layout whose fingerprint comes out selects the mapping; paths beside it do not
matter.
For tables the paths come from the Spark schema; for JSON records they come from
``schema_of_variant`` row by row, so one table may mix layouts.

A conversation is formatted as one ``<turn:ROLE>TEXT</turn>\n`` per turn.  Inside
TEXT, every ``<``, followed by any backslashes and then ``turn:`` or ``/turn>``,
gets one more backslash after the ``<``; removing one backslash in the same places
reverses it, so no control string survives in a text and nothing is lost.  In
ROLE, ``%``, ``<`` and ``>`` are percent-encoded.  The output keeps the formatted
string as segments with a loss flag; the flag is true for assistant texts only.

Defined results.  Null text or role: empty.  Null conv_id: one conversation of its
own.  Turns are ordered by (turn, role, text), nulls first, so ties and repeated
rows have one order and all are kept.  A conversation's string and digest need all
its turns in one value; each turn is formatted before the shuffle and a
conversation is held once, in one row.  Extra columns are ignored.  A layout
without a mapping raises for tables; such JSON records are returned with their
fingerprint and null turns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: Layout name -> (the field paths that name it, mapping). A mapping is ("rows", id, order, role, text),
#: ("list", path of the array, role field, text field) or ("fields", [(role, [text fields joined by a blank line])]).
LAYOUTS: dict[str, tuple[tuple[str, ...], tuple]] = {
    "turn_rows": (("role", "text", "turn"), ("rows", "conv_id", "turn", "role", "text")),
    "messages": (("messages[].content", "messages[].role"), ("list", "messages", "role", "content")),
    "from_value": (("conversations[].from", "conversations[].value"), ("list", "conversations", "from", "value")),
    "alpaca": (("input", "instruction", "output"), ("fields", [("user", ["instruction", "input"]), ("assistant", ["output"])])),
    "instruction_output": (("instruction", "output"), ("fields", [("user", ["instruction"]), ("assistant", ["output"])])),
    "instruction_response": (("instruction", "response"), ("fields", [("user", ["instruction"]), ("assistant", ["response"])])),
    "prompt_completion": (("completion", "prompt"), ("fields", [("user", ["prompt"]), ("assistant", ["completion"])])),
    "prompt_response": (("prompt", "response"), ("fields", [("user", ["prompt"]), ("assistant", ["response"])])),
    "system_prompt_response": (("prompt", "response", "system"), ("fields", [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])])),
    "question_answer": (("answer", "question"), ("fields", [("user", ["question"]), ("assistant", ["answer"])])),
}
KNOWN_PATHS = sorted({p for paths, _ in LAYOUTS.values() for p in paths})

#: Roles as the layouts of records name them; a table of turns keeps its roles as they are.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LOSS_ROLES = ("assistant",)


def _hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {_hash(paths): name for name, (paths, _) in LAYOUTS.items()}
#: Layouts with more paths come first, so fields that lie beside a layout's own do not hide it.
BY_SIZE = sorted(LAYOUTS, key=lambda name: -len(LAYOUTS[name][0]))


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested paths of all leaves; ``[]`` marks an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(schema: T.StructType) -> str:
    """Hash of the schema's paths: of those that the largest layout names which is whole in it, else of all known ones."""
    found = set(field_paths(schema)) & set(KNOWN_PATHS)
    hashes = (_hash(found & set(LAYOUTS[n][0])) for n in BY_SIZE)
    return next((h for h, n in zip(hashes, BY_SIZE, strict=True) if FINGERPRINTS.get(h) == n), _hash(found))


def _turns_of(layout: str, record) -> Column:
    """array<struct<role,text>> of one record; ``record(name)`` gives a field as a column."""
    kind, *how = LAYOUTS[layout][1]
    if kind == "list":
        path, role, text = how
        return F.transform(record(path), lambda m: F.struct(F.coalesce(m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    turns = []
    for role, names in how[0]:
        parts = F.array(*[F.coalesce(record(n), F.lit("")) for n in names])
        turns.append(F.struct(F.lit(role).alias("role"), F.array_join(F.filter(parts, lambda x: x != ""), "\n\n").alias("text")))
    made = F.array(*turns)
    return F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != "")) if layout == "system_prompt_response" else made


def _canonical_roles(turns: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.transform(turns, lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))


def canonical_turns(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id and turns array<struct<role,text>> of a table in any known layout."""
    layout = FINGERPRINTS.get(fingerprint(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for the layout with paths {field_paths(df.schema)}")
    kind, *how = LAYOUTS[layout][1]
    if kind == "rows":
        cid, order, role, text = how
        one = F.struct(F.col(order).alias("o"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        turns = F.transform(F.sort_array("rows"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return df.groupBy(F.col(cid).alias("conv_id")).agg(F.collect_list(one).alias("rows")).select("conv_id", turns.alias("turns"))
    return df.select(F.col(id_column).alias("conv_id"), _canonical_roles(_turns_of(layout, F.col)).alias("turns"))


def variant_paths(schema_text: Column) -> Column:
    """Known paths present in a ``schema_of_variant`` text, sorted."""
    found = []
    for p in KNOWN_PATHS:
        if "[]." in p:
            top, leaf = p.split("[].")
            here = schema_text.rlike(rf"(?:^OBJECT<|, )`?{top}`?: ARRAY<OBJECT<(?:[^<>]*, )?`?{leaf}`?: ")
        else:
            here = F.regexp_replace(F.regexp_replace(schema_text, r"ARRAY<OBJECT<[^<>]*>>", "ARRAY"), r"(?<=: )OBJECT<[^<>]*>", "OBJECT").rlike(rf"(?:^OBJECT<|, )`?{p}`?: ")
        found.append(F.when(here, F.lit(p)))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def variant_fingerprint(paths: Column) -> Column:
    """As :func:`fingerprint`, of the known paths of one record."""
    out = F.sha2(F.array_join(paths, "\n"), 256)
    for n in reversed(BY_SIZE):
        own = F.array(*[F.lit(p) for p in LAYOUTS[n][0]])
        hashed = F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, own)), "\n"), 256)
        out = F.when(hashed == _hash(LAYOUTS[n][0]), hashed).otherwise(out)
    return out


def canonical_json(df: DataFrame, json_column: str = "record", id_column: str = "conv_id") -> DataFrame:
    """conv_id, fingerprint and turns of JSON records whose layouts differ from row to row."""
    v = F.try_parse_json(json_column)
    base = df.select(F.col(id_column).alias("conv_id"), v.alias("v")).withColumn("paths", variant_paths(F.schema_of_variant("v"))).withColumn("fingerprint", variant_fingerprint(F.col("paths")))
    pick = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (paths, mapping) in LAYOUTS.items():
        if mapping[0] == "rows":
            continue

        def record(field, mapping=mapping):
            if mapping[0] == "list":
                return F.try_variant_get("v", f"$.{field}", f"array<struct<{mapping[2]}:string,{mapping[3]}:string>>")
            return F.try_variant_get("v", f"$.{field}", "string")

        pick = F.when(F.col("fingerprint") == _hash(paths), _canonical_roles(_turns_of(name, record))).otherwise(pick)
    return base.select("conv_id", "fingerprint", pick.alias("turns"))


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)(turn:|/turn>)", r"<\\$1$2")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<\\")), F.regexp_replace(text, r"<\\(\\*)(turn:|/turn>)", r"<$1$2")).otherwise(text)


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3E"), F.lit(">")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


CLOSE = "</turn>\n"


def format_turns(canonical: DataFrame) -> DataFrame:
    """conv_id, formatted text, and its segments array<struct<text,loss>> whose texts join to it."""

    def three(t):
        return F.array(
            F.struct(F.concat(F.lit("<turn:"), _escape_role(t["role"]), F.lit(">")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*LOSS_ROLES).alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
        )

    made = canonical.select("conv_id", F.flatten(F.transform("turns", three)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted text."""
    pieces = F.filter(F.split(formatted, r"</turn>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(F.substr(p, F.lit(7)), ">", 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, ">", 1)) + 2)).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted output."""
    back = formatted.select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = store.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    kind = {f.name: f.dataType for f in table.schema}
    extra = spark.range(2).select(
        F.lit(-7).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    return digest(format_turns(canonical_turns(table.unionByName(extra))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(regexp_replace(text, '<(\\*)(turn:|/turn>)', '<\\\1\2', 'g')) + 15
        + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

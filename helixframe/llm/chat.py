"""Chat formatting by schema fingerprint, in DataFrame operations only.

The nested field paths of a record, as read from its schema, are hashed; the fingerprint
selects a declarative mapping that brings the record into canonical turns (role, text).
Struct columns have one fingerprint, found from the schema when the plan is made; variant
columns hold mixed layouts, so each row's own schema is hashed and matched.

Canonical turns are written as ``### role: text</turn>`` and a line end. Inside roles and
texts ``\\`` becomes ``\\b``, ``<`` ``\\l``, ``#`` ``\\h`` and, in roles, ``:`` ``\\c``,
so no control string can appear in them and each text can be read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
_TEXT = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
_ROLE = [*_TEXT, (":", "\\c")]
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """paths: the nested field paths of the layout, ``[]`` for list elements. turns: either
    ("list", list path, role field, text field) or ("fields", (role, (path, ...)), ...);
    several paths are joined by a line end, null and empty parts left out. renames: role
    names of the layout that have another canonical name."""

    name: str
    paths: tuple[str, ...]
    turns: tuple
    renames: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


_HUMAN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), ("list", "messages", "role", "content"), _HUMAN),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), ("list", "conversations", "from", "value"), _HUMAN),
    Mapping("turns", ("turns", "turns[].role", "turns[].text"), ("list", "turns", "role", "text"), _HUMAN),
    Mapping("prompt-completion", ("prompt", "completion"), ("fields", ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt-response", ("prompt", "response"), ("fields", ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question-answer", ("question", "answer"), ("fields", ("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction-output", ("instruction", "output"), ("fields", ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input-output", ("instruction", "input", "output"), ("fields", ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system-prompt-response", ("system", "prompt", "response"), ("fields", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a struct schema."""
    out = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        if isinstance(kind, T.StructType):
            out += [path, *schema_paths(kind, f"{path}.")]
        elif isinstance(kind, T.ArrayType):
            out.append(path)
            if isinstance(kind.elementType, T.StructType):
                out += schema_paths(kind.elementType, f"{path}[].")
        else:
            out.append(path)
    return out


def _clean(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column, mapping: Mapping) -> Column:
    out = _clean(c)
    for old, new in mapping.renames:
        out = F.when(out == old, F.lit(new)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _joined(parts: list[Column]) -> Column:
    if len(parts) == 1:
        return _clean(parts[0])
    return F.concat_ws("\n", *[F.when(_clean(p) != "", _clean(p)) for p in parts])


def _struct_turns(record: Column, mapping: Mapping) -> Column:
    if mapping.turns[0] == "list":
        _, path, role, text = mapping.turns
        got = F.transform(record[path], lambda m: _turn(_role(m[role], mapping), _clean(m[text])))
        return F.coalesce(got, F.array().cast(TURNS))
    return F.array(*[_turn(F.lit(role), _joined([record[p] for p in paths])) for role, paths in mapping.turns[1:]]).cast(TURNS)


def _variant_turns(record: Column, mapping: Mapping) -> Column:
    if mapping.turns[0] == "list":
        _, path, role, text = mapping.turns
        items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
        got = F.transform(items, lambda m: _turn(_role(m[role], mapping), _clean(m[text])))
        return F.coalesce(got, F.array().cast(TURNS))
    part = lambda p: F.try_variant_get(record, f"$.{p}", "string")
    return F.array(*[_turn(F.lit(role), _joined([part(p) for p in paths])) for role, paths in mapping.turns[1:]]).cast(TURNS)


def variant_shape(record: Column) -> Column:
    """Layout text of a variant row: schema with the kinds of scalar values left out."""
    kinds = r": (STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP|VARIANT)"
    return F.regexp_replace(F.schema_of_variant(record), kinds, "")


def _shapes(mapping: Mapping) -> list[str]:
    """What variant_shape gives for records of the mapping's layout (fields by name); lists may be empty."""
    if mapping.turns[0] == "list":
        _, path, role, text = mapping.turns
        return [f"OBJECT<{path}: ARRAY<OBJECT<{', '.join(sorted((role, text)))}>>>", f"OBJECT<{path}: ARRAY<VOID>>"]
    return [f"OBJECT<{', '.join(sorted(mapping.paths))}>"]


def canonical_turns(records: DataFrame, column: str, mappings=MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout (mapping name or null) and turns.

    ``column`` is a struct or a variant (see ``parse_json``). A layout that no mapping
    fits, or a null record, has a null layout and no turns; it is not dropped. Null roles
    and texts are empty, an empty list of messages has no turns. Repeated records are rows
    like others, other columns pass through, an empty table gives an empty result.
    """
    kind = records.schema[column].dataType
    record = F.col(column)
    if isinstance(kind, T.StructType):
        mark = fingerprint_of(schema_paths(kind))
        hit = next((m for m in mappings if m.fingerprint == mark), None)
        turns = _struct_turns(record, hit) if hit else F.array().cast(TURNS)
        return records.withColumns({"fingerprint": F.lit(mark), "layout": F.lit(hit.name if hit else None).cast("string"), "turns": turns})
    shape = F.sha2(variant_shape(record), 256)
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in mappings:
        same = F.col("fingerprint").isin([hashlib.sha256(x.encode()).hexdigest() for x in _shapes(m)])
        layout = F.when(same, F.lit(m.name)).otherwise(layout)
        turns = F.when(same, _variant_turns(record, m)).otherwise(turns)
    return records.withColumn("fingerprint", shape).withColumns({"layout": layout, "turns": turns})


def _escape(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _unescape(c: Column, pairs) -> Column:
    for old, new in reversed(pairs):
        c = F.replace(c, F.lit(new), F.lit(old))
    return c


def render(turns: Column) -> Column:
    """The formatted conversation."""
    one = lambda t: F.concat(F.lit(OPEN), _escape(t["role"], _ROLE), F.lit(MID), _escape(t["text"], _TEXT), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, roles=("assistant",)) -> Column:
    """[start, end) in code points of each text of the given roles in ``render(turns)``."""
    def add(acc, t):
        head = acc["at"] + len(OPEN) + len(MID) + F.length(_escape(t["role"], _ROLE))
        end = head + F.length(_escape(t["text"], _TEXT))
        span = F.array(F.struct(head.alias("start"), end.alias("end")))
        spans = F.when(t["role"].isin(*roles), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, add)["spans"]


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: the inverse of render."""
    parts = F.split(formatted, CLOSE)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def one(p: Column) -> Column:
        body = F.substring(p, len(OPEN) + 1, 1 << 30)
        at = F.instr(body, MID)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(MID))
        return _turn(_unescape(role, _ROLE), _unescape(text, _TEXT))

    return F.transform(bodies, one)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped text under each span of the loss mask."""
    return F.transform(spans, lambda s: _unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]), _TEXT))


def nest(messages: DataFrame) -> DataFrame:
    """(conv_id, record): rows (conv_id, turn, role, text) as records of the messages layout.

    Rows go by turn, then role and text; null turns come first; null conv_ids form one
    conversation. A conversation is one record, so it has to fit into one row.
    """
    item = F.struct("turn", _clean(F.col("role")).alias("role"), _clean(F.col("text")).alias("text"))
    grouped = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    content = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return grouped.select("conv_id", F.struct(content.alias("messages")).alias("record"))


#: Mappings for records whose role names are canonical but for those of the conversations layout.
CANONICAL_ROLES = tuple(m if m.name == "conversations" else replace(m, renames=()) for m in MAPPINGS)


def in_layouts(nested: DataFrame) -> DataFrame:
    """The records of ``nest`` as variants in four layouts, dealt by the remainder of conv_id.

    Remainder 1 has the conversations layout with its own role names, 2 the turns layout, 3
    prompt and response. Conversations that a layout can't hold (roles but user, assistant
    and system; not one question and one answer), remainder 0 and null conv_ids have
    messages. A record must fit into a variant (128 MiB).
    """
    m = F.col("record.messages")
    told = F.transform(m, lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["content"].alias("value")))
    turns = F.transform(m, lambda x: F.struct(x["role"], x["content"].alias("text")))
    known = F.forall(m, lambda x: x["role"].isin("user", "assistant", "system"))
    pair = (F.size(m) == 2) & (F.get(m, F.lit(0))["role"] == "user") & (F.get(m, F.lit(1))["role"] == "assistant")
    asked = F.struct(F.get(m, F.lit(0))["content"].alias("prompt"), F.get(m, F.lit(1))["content"].alias("response"))
    turn = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    record = (
        F.when((turn == 1) & known, F.to_variant_object(F.struct(told.alias("conversations"))))
        .when(turn == 2, F.to_variant_object(F.struct(turns.alias("turns"))))
        .when((turn == 3) & pair, F.to_variant_object(asked))
        .otherwise(F.to_variant_object(F.col("record")))
    )
    return nested.select("conv_id", record.alias("record"))


def digest(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Digests of formatted conversations (conv_id, record), all read back from the formatted text.

    A record whose layout no mapping fits, null included, keeps its row with null digests.
    Null and empty texts add nothing but their turn; texts of any length are read back whole.
    Repeated records are rows like others, other columns are left out, an empty table gives
    an empty result.
    """
    turns = canonical_turns(records, "record", mappings).withColumn("turns", F.when(F.col("layout").isNotNull(), F.col("turns")))
    made = turns.select("conv_id", render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("spans"))
    back = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), F.array_join(masked_texts(F.col("formatted"), F.col("spans")), "").alias("loss"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    long = lambda c: c.cast("long")
    return back.select(
        "conv_id", long(F.when(F.col("back").isNotNull(), F.size("back"))).alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        long(F.length("loss")).alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), long(F.length("formatted")).alias("formatted_chars"),
    )

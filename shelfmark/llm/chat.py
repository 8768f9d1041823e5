"""Operator 10: chat formatting by schema fingerprints, with DataFrame functions only.

A record's layout is told by a hash of its sorted nested field paths. Each known fingerprint selects a declarative mapping
(which path gives which turn, or which path lists turns and how they name role and text), so prompts, instructions and
message lists in one column all become canonical turns. Turns are rendered as ``[INST]role[/INST]text</s>``; inside roles and
texts the control strings are broken by an escape that can be undone, so the output splits back without loss.

Defined cases: null texts and roles are empty; turns with equal numbers are ordered by role and text, null numbers come first; an
unknown layout gives no turns and keeps its fingerprint; an empty table gives no row; extra columns and fields are ignored where a mapping names
its paths, and change the fingerprint where they lie inside a JSON record.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, CLOSE, END, "<s>")
#: An escape is MARK + KEPT for a mark of the text itself, and MARK + BREAK inside a broken control string.
MARK, KEPT, BREAK = "\ue000", "\ue001", "\ue002"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Either ``single`` ((role, path) in order, an absent or empty text giving no turn) or ``listed`` (path of the list, name of role, name of text)."""

    paths: tuple[str, ...]
    single: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def fingerprint(self) -> int:
        return fingerprint_of(self.paths)


def fingerprint_of(paths: tuple[str, ...]) -> int:
    return crc32("\n".join(sorted(paths)).encode())


ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout(("prompt", "completion"), single=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Layout(("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"), single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("system", "instruction", "output"), single=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout(("messages[].role", "messages[].content"), listed=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value"), roles=ROLE_NAMES),
    Layout(("turns[].role", "turns[].text"), listed=("turns", "role", "text")),
)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a typed column, leaves only; ``[]`` stands for the items of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def record_paths(record: Column) -> Column:
    """The same for a JSON record of up to two levels (an object of scalars and of lists of objects), sorted and distinct."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    value = lambda k, tail: F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit(tail)))
    # only a list has a first item; a text that looks like a list stays a scalar
    inner = lambda k: F.coalesce(F.when(value(k, "'][0]").isNotNull(), F.from_json(value(k, "']"), "array<map<string,string>>")), F.array().cast("array<map<string,string>>"))
    below = lambda k: F.array_distinct(F.flatten(F.transform(inner(k), lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
    paths = F.transform(top, lambda k: F.when(F.size(below(k)) > 0, F.transform(below(k), lambda n: F.concat(k, F.lit("[]."), n))).otherwise(F.array(k)))
    return F.array_sort(F.array_distinct(F.flatten(paths)))


def record_fingerprint(record: Column) -> Column:
    return F.crc32(F.array_join(record_paths(record), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column, names: dict[str, str]) -> Column:
    return reduce(lambda out, item: F.when(role == item[0], F.lit(item[1])).otherwise(out), names.items(), role)


def _reader(role: str, text: str, names: dict[str, str]):
    return lambda x: _turn(_renamed(x[role], names), x[text])


def turns_of_records(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of JSON records whose layouts differ from row to row; empty for unknown ones."""
    print_, out = record_fingerprint(record), F.array().cast(TURNS)
    for layout in layouts:
        if layout.listed:
            path, role, text = layout.listed
            items = F.from_json(F.get_json_object(record, f"$.{path}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = F.transform(F.coalesce(items, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), _reader(role, text, layout.roles))
        else:
            one = lambda role, path: F.when(F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit("")) != "", _turn(F.lit(role), F.get_json_object(record, f"$.{path}")))
            turns = F.array_compact(F.array(*[one(role, path) for role, path in layout.single]))
        out = F.when(print_ == layout.fingerprint, turns.cast(TURNS)).otherwise(out)
    return out


def turns_of_column(df: DataFrame, name: str, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a typed struct column; the layout is chosen once, by the fingerprint of its type."""
    own = fingerprint_of(tuple(schema_paths(df.schema[name].dataType)))
    layout = next((x for x in layouts if x.fingerprint == own), None)
    if layout is None:
        return F.array().cast(TURNS)
    if layout.listed:
        path, role, text = layout.listed
        return F.transform(F.col(name)[path], _reader(role, text, layout.roles)).cast(TURNS)
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(name)[path], F.lit("")) != "", _turn(F.lit(role), F.col(name)[path])) for role, path in layout.single])).cast(TURNS)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(MARK), F.lit(MARK + KEPT))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + MARK + BREAK + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + BREAK), F.lit("")), F.lit(MARK + KEPT), F.lit(MARK))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(CLOSE), escaped(t["text"]), F.lit(END))), "")


def parsed(formatted: Column) -> Column:
    """Turns (still escaped) with the place of each text (0-based code points): array<struct<role, text, start>>."""
    pieces = F.filter(F.split(formatted, r"</s>", -1), lambda p: p != "")
    cut = lambda p: F.struct(F.length(p).alias("n"), F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 2**31 - 1).alias("role"), F.substring(p, F.instr(p, CLOSE) + len(CLOSE), F.length(p)).alias("text"))
    return F.transform(pieces, cut)


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Spans (start, length in code points of the formatted string) of the texts of ``role``, in order."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        end = state["at"] + t["n"]
        spans = F.when((t["role"] == role) & (F.length(t["text"]) > 0), F.concat(state["spans"], F.array(F.struct((end - F.length(t["text"])).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def grouped_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): the rows of a conversation as one message list; partial lists are made before the shuffle."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = F.collect_list(F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")))
    turns = F.transform(F.array_sort(listed), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.struct(turns.alias("turns")).alias("record"))


def mixed_records(grouped: DataFrame) -> DataFrame:
    """(conv_id, record): conversations of one message list each (as from ``grouped_turns``) as JSON records of many layouts, without loss.

    Where the roles allow it and no text is empty, a conversation becomes a pair or an instruction: user and assistant a prompt with a completion, a prompt
    with a response or an instruction with an output, by the hash of its id; two user turns and an assistant an instruction with an input; system,
    user and assistant a system prompt with an instruction. All others are lists: of messages, of turns, or where every role is one of user, assistant and
    system, also of from and value.
    """
    turns = F.col("record")["turns"]
    roles = F.array_join(F.transform(turns, lambda t: F.replace(t["role"], F.lit(","), F.lit(", "))), ",")
    full = ~F.exists(turns, lambda t: t["text"] == "")
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    text = lambda i: turns[i]["text"]
    record = lambda **parts: F.to_json(F.struct(*[column.alias(name) for name, column in parts.items()]))
    listed = lambda name, role, words, names: record(**{name: F.transform(turns, lambda t: F.struct(_renamed(t["role"], names).alias(role), t["text"].alias(words)))})
    plain = F.forall(turns, lambda t: t["role"].isin("user", "assistant", "system"))
    out = F.when(full & (roles == "user,assistant") & (kind == 0), record(prompt=text(0), completion=text(1)))
    out = out.when(full & (roles == "user,assistant") & (kind == 1), record(prompt=text(0), response=text(1)))
    out = out.when(full & (roles == "user,assistant"), record(instruction=text(0), output=text(1)))
    out = out.when(full & (roles == "user,user,assistant"), record(instruction=text(0), input=text(1), output=text(2)))
    out = out.when(full & (roles == "system,user,assistant"), record(system=text(0), instruction=text(1), output=text(2)))
    out = out.when(plain & (kind == 0), listed("conversations", "from", "value", {"user": "human", "assistant": "gpt"}))
    out = out.when(kind == 1, listed("turns", "role", "text", {}))
    return grouped.select("conv_id", out.otherwise(listed("messages", "role", "content", {})).alias("record"))


def formatted(records: DataFrame, name: str = "record") -> DataFrame:
    """conv_id, formatted, loss_spans for a column of typed or JSON records."""
    turns = turns_of_records(F.col(name)) if isinstance(records.schema[name].dataType, T.StringType) else turns_of_column(records, name)
    out = records.select("conv_id", rendered(turns).alias("formatted"))
    return out.withColumn("loss_spans", loss_mask(parsed(F.col("formatted"))))


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and masks hold."""
    turns = output.withColumn("turns", parsed(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(unescaped(t["role"]), F.lit("\n"), unescaped(t["text"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))

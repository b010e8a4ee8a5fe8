"""Chat formatting: records of several layouts to canonical turns, turns to one text.

A record is a VARIANT. Its schema with the scalar types left out is the set of its nested
field paths; the hash of that is its fingerprint, which selects one of ``LAYOUTS``. A layout
says where roles and contents lie and which names the roles have. A layout with ``turns``
reads a list of messages; one with ``parts`` reads fixed fields; optional fields give a
layout several fingerprints. Records of no known layout get NULL turns and are kept.

The template writes ``<|start|>role<|sep|>content<|end|>`` and a line feed per turn. In roles
and contents every backslash is doubled and control strings, those of other templates
included, get a backslash and a hyphen after their first character, so that none is left;
``read_turns`` undoes both. The loss mask is a list of spans (code points, end exclusive) of
the formatted text that hold assistant contents.

Only DataFrame functions are used. NULL roles and contents are empty; turns of a conversation
are ordered by turn number, NULL first, then role and content, and repeated rows are repeated
turns. A conversation becomes one text, so it must fit into one row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"  # fixed values, as the next one
CONTROL = [START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]"]
SCALARS = r": ?(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|BINARY|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\(\d+, ?\d+\))"
TURNS = "array<struct<turn: bigint, role: string, content: string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record lie."""

    name: str
    turns: str | None = None  # path of the list of messages; "$" where the record is one message
    role: str = "role"
    content: str = "content"
    turn: str | None = None  # field with the turn's number, for records of one message
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields joined by a blank line)
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def examples(self) -> list[dict]:
        """A record for each set of optional fields."""
        out = []
        for n in range(len(self.optional) + 1):
            for left_out in combinations(self.optional, n):
                if self.parts:
                    record = {f: "" for _, fields in self.parts for f in fields if f not in left_out}
                else:
                    record = {f: "" for f in (self.role, self.content, *([self.turn] if self.turn else []), *self.optional) if f not in left_out}
                    for step in reversed(self.turns.split(".")[1:]):
                        record = {step: [record] if step == self.turns.split(".")[-1] else record}
                out.append(record)
        return out


LAYOUTS = [
    Layout("row", turns="$", turn="turn"),
    Layout("messages", turns="$.messages"),
    Layout("nested messages", turns="$.data.messages"),
    Layout("conversations", turns="$.conversations", role="from", content="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt and response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", parts=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
]


def paths(record: Column) -> Column:
    """The nested field paths of a variant."""
    return F.regexp_replace(F.schema_of_variant(record), SCALARS, "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def _turns(record: Column, layout: Layout) -> Column:
    def text(v: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    def named(role: Column) -> Column:
        out = role
        for theirs, ours in layout.roles.items():
            out = F.when(role == theirs, ours).otherwise(out)
        return out

    if layout.parts:
        parts = []
        for role, fields in layout.parts:
            got = F.array_compact(F.array(*[F.try_variant_get(record, f"$.{f}", "string") for f in fields]))
            present = F.size(got) > 0 if set(fields) <= set(layout.optional) else F.lit(True)
            parts.append(F.when(present, F.struct(F.lit(len(parts)).cast("long").alias("turn"), F.lit(role).alias("role"), F.array_join(F.filter(got, lambda x: x != ""), "\n\n").alias("content"))))
        return F.array_compact(F.array(*parts)).cast(TURNS)
    if layout.turns == "$":
        turn = F.try_variant_get(record, f"$.{layout.turn}", "bigint") if layout.turn else F.lit(0).cast("long")
        return F.array(F.struct(turn.alias("turn"), named(text(record, f"$.{layout.role}")).alias("role"), text(record, f"$.{layout.content}").alias("content"))).cast(TURNS)
    items = F.try_variant_get(record, layout.turns, "array<variant>")
    return F.transform(items, lambda v, i: F.struct(
        i.cast("long").alias("turn"), named(text(v, f"$.{layout.role}")).alias("role"), text(v, f"$.{layout.content}").alias("content"))).cast(TURNS)


def canonical(records: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """The table with its columns and ``layout`` and ``turns``."""
    known = records.sparkSession.range(1).select(F.array(*[
        F.struct(fingerprint(F.parse_json(F.lit(json.dumps(e)))).alias("print"), F.lit(i).alias("layout"))
        for i, layout in enumerate(layouts) for e in layout.examples()
    ]).alias("known")).first()["known"]  # constants of the layouts, no data
    which = F.create_map(*[x for k in known for x in (F.lit(k["print"]), F.lit(k["layout"]))])
    found = records.withColumn("_layout", F.try_element_at(which, fingerprint(F.col(record))))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        turns = F.when(F.col("_layout") == i, _turns(F.col(record), layout)).otherwise(turns)
        name = F.when(F.col("_layout") == i, layout.name).otherwise(name)
    return found.withColumns({"layout": name, "turns": turns}).drop("_layout")


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<(?=\|(?:start|sep|end)\|>|/?s>)|\[(?=/?INST\])", r"$0\\-")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:-|(\\))", "$1")


def formatted(turns: Column) -> Column:
    """Canonical turns, in order, to a struct of the text and its loss spans."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["content"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    state = "struct<at: bigint, spans: array<struct<start: bigint, stop: bigint>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(state)

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(END) + 1).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans")).cast(state)

    return F.struct(text.alias("text"), F.aggregate(pieces, begin, step, lambda s: s["spans"]).alias("loss_spans"))


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of single turns to one formatted row per conversation: ``key``, text, loss_spans."""
    c = lambda name: F.col(f"`{name}`")
    message = F.struct(c(turn).cast("long").alias("turn"), F.coalesce(c(role).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text).cast("string"), F.lit("")).alias("content"))
    one = canonical(rows.select(c(key).alias("key"), F.to_variant_object(message).alias("record")), "record")
    whole = one.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("turns")), _in_order).alias("turns"))
    return whole.select(F.col("key").alias(key), formatted(F.col("turns")).alias("f")).select(key, "f.text", "f.loss_spans")


def _in_order(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for name in ("content", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def read_turns(text: Column) -> Column:
    """Formatted text back to an array of (role, content)."""
    parts = F.split(text, r"<\|end\|>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, SEP, 1), len(START) + 1, 2147483647)).alias("role"),
        unescape(F.substring_index(p, SEP, -1)).alias("content")))


def read_loss(text: Column, spans: Column) -> Column:
    """The contents under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))

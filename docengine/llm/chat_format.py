"""Chat formatting with schema fingerprints; DataFrame functions only.

A record's layout is the set of nested field paths that it has, over all its
list elements; the hash of those paths is its fingerprint.  Each distinct
fingerprint is looked up once in the table of declared mappings, and the hash
then selects the mapping of every record that has it.  All mappings end in the
same canonical turns: one row per turn with conversation, position, role and
text.  Records without a mapping are reported with their fingerprint.  The
template is built from the turns, with running offsets for the loss mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"

#: Escapes, applied in this order and undone in reverse; afterwards no text
#: holds ``<`` or ``[``, with which every control string begins.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``paths`` are the field paths that the layout must have.  ``kind`` is
    ``rows`` (one row per turn: ``order``, ``role``, ``text`` name columns),
    ``list`` (an array at ``items`` of structs with ``role`` and ``text``) or
    ``pairs`` (``turns``: role and the paths whose texts it says, joined by a
    blank line).
    """

    name: str
    kind: str
    paths: tuple[str, ...]
    order: str = ""
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = (
    Mapping("turn_rows", "rows", ("turn", "role", "text"), order="turn", role="role", text="text"),
    Mapping("messages", "list", ("messages", "messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Mapping("conversations", "list", ("conversations", "conversations[].from", "conversations[].value"), items="conversations", role="from", text="value"),
    Mapping("instruction", "pairs", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", "pairs", ("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_response", "pairs", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", "pairs", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", "pairs", ("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("system_question_answer", "pairs", ("system", "question", "answer"), turns=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
)

#: Role names of other layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Most distinct fingerprints that are sent to all tasks as one small table.
MOST_LAYOUTS = 10_000

TURN_SCHEMA = "conv_id long, pos long, role string, text string"


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """All nested field paths; array elements are marked ``[]``."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        out.append(path)
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        if isinstance(kind, T.StructType):
            out += field_paths(kind, path + ".")
    return out


def fingerprint(paths: Column) -> Column:
    """Hash of an array of field paths, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)


def fingerprint_of(paths: Iterable[str]) -> str:
    """``fingerprint`` of paths that are known to the driver."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def known_paths(mappings: tuple[Mapping, ...]) -> list[str]:
    """The paths that fingerprints are made of; fields that no mapping names do not matter."""
    return sorted({p for m in mappings for p in m.paths})


def pick(paths: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping that the fingerprint of ``paths`` selects.

    A fingerprint that is not in the table of declared ones takes the mapping
    with the most paths, all of which it has.
    """
    own = set(paths) & set(known_paths(mappings))
    table = {fingerprint_of(m.paths): m for m in mappings}
    fits = [m for m in mappings if set(m.paths) <= own]
    return table.get(fingerprint_of(own), max(fits, key=lambda m: len(m.paths), default=None))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv]), out), out)


def _said(parts: list[Column]) -> Column:
    """The texts that are not null or empty, joined by a blank line."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def turns_from_frame(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of a typed table, by the fingerprint of its schema.

    Rows by turn are ordered by ``turn``, then role and text; their roles are
    kept as they are.  Lists and pairs get the usual role names.  Null roles and
    texts are empty, repeated rows repeat their turns, rows with a null id are
    one conversation, and an empty table has no turns.  Columns that no mapping
    names are ignored.  Raises ValueError where no mapping fits.
    """
    m = pick(field_paths(df.schema), mappings)
    if m is None:
        raise ValueError(f"no mapping for the fields {df.columns}")
    conv = F.col(id_col).cast("long").alias("conv_id")
    if m.kind == "rows":
        rows = df.select(conv, F.col(m.order).alias("at"), F.coalesce(F.col(m.role), F.lit("")).alias("role"), F.coalesce(F.col(m.text).cast("string"), F.lit("")).alias("text"))
        pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_last(), "role", "text"))
        return rows.select("conv_id", pos.cast("long").alias("pos"), "role", "text")
    if m.kind == "list":
        rows = df.select(conv, F.posexplode(F.col(m.items)).alias("at", "item"))
        return rows.select("conv_id", (F.col("at") + 1).cast("long").alias("pos"), _role(F.col(f"item.{m.role}")).alias("role"), F.coalesce(F.col(f"item.{m.text}"), F.lit("")).alias("text"))
    said = [F.struct(F.lit(role).alias("role"), _said([F.col(p) for p in parts]).alias("text")) for role, parts in m.turns]
    rows = df.select(conv, F.posexplode(F.array(*said)).alias("at", "item"))
    return rows.select("conv_id", (F.col("at") + 1).cast("long").alias("pos"), "item.role", "item.text")


def _present(record: Column, path: str) -> Column:
    """The path if the record has it; a path into a list, if any element has it."""
    items, inside, field = path.partition("[].")
    if not inside:
        return F.when(F.try_variant_get(record, f"$.{path}", "variant").isNotNull(), F.lit(path))
    some = F.exists(F.try_variant_get(record, f"$.{items}", "array<variant>"), lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())
    return F.when(some, F.lit(path))


def _item_reader(m: Mapping) -> Callable[[Column], Column]:
    """Reads one element of a list layout; null elements become empty turns."""

    def read(item: Column) -> Column:
        said = F.coalesce(F.try_variant_get(item, f"$.{m.text}", "string"), F.lit(""))
        return F.struct(_role(F.try_variant_get(item, f"$.{m.role}", "string")).alias("role"), said.alias("text"))

    return read


def fingerprinted(df: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, record`` (variant, null if it is no JSON)``, fingerprint, mapping`` (null: none fits).

    The mapping is settled once for each distinct fingerprint and found by it;
    the table of distinct fingerprints is sent to all tasks if it has at most
    MOST_LAYOUTS rows and joined by shuffle if there are more.
    """
    named = [m for m in mappings if m.kind != "rows"]
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.try_parse_json(F.col(json_col)).alias("record"))
    paths = F.array_compact(F.array(*[_present(F.col("record"), p) for p in known_paths(tuple(named))]))
    rows = rows.withColumn("paths", paths).withColumn("fingerprint", fingerprint(F.col("paths")))
    layouts = rows.select("fingerprint", "paths").dropDuplicates(["fingerprint"])
    mapping = F.lit(None).cast("string")
    for m in sorted(named, key=lambda m: len(m.paths)):  # the one with the most paths is asked last and wins
        mapping = F.when(F.size(F.array_except(F.array(*[F.lit(p) for p in m.paths]), "paths")) == 0, F.lit(m.name)).otherwise(mapping)
    for m in named:
        mapping = F.when(F.col("fingerprint") == fingerprint_of(m.paths), F.lit(m.name)).otherwise(mapping)
    layouts = layouts.select("fingerprint", mapping.alias("mapping"))
    few = layouts.limit(MOST_LAYOUTS + 1).count() <= MOST_LAYOUTS
    return rows.drop("paths").join(F.broadcast(layouts) if few else layouts, "fingerprint")


def unmapped(df: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records that give no turns: ``conv_id, fingerprint, reason`` (``no json`` or ``unknown layout``)."""
    rows = fingerprinted(df, id_col, json_col, mappings).where("mapping is null")
    return rows.select("conv_id", "fingerprint", F.when(F.col("record").isNull(), "no json").otherwise("unknown layout").alias("reason"))


def turns_from_json(df: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records, each by the fingerprint of its own fields.

    Rows that are not JSON, or that no mapping fits, give no turns; ``unmapped``
    reports them.  Repeated rows repeat their turns; null elements are empty
    turns; an empty table gives no turns.
    """
    turn = "array<struct<role:string,text:string>>"
    found = F.lit(None).cast(turn)
    for m in mappings:
        if m.kind == "list":
            said = F.transform(F.try_variant_get("record", f"$.{m.items}", "array<variant>"), _item_reader(m))
        elif m.kind == "pairs":
            parts = {p: F.try_variant_get("record", f"$.{p}", "string") for p in m.paths}
            said = F.array(*[F.struct(F.lit(role).alias("role"), _said([parts[p] for p in own]).alias("text")) for role, own in m.turns])
        else:
            continue
        found = F.when(F.col("mapping") == m.name, said.cast(turn)).otherwise(found)
    rows = fingerprinted(df, id_col, json_col, mappings).select("conv_id", F.posexplode(found).alias("at", "item"))
    return rows.select("conv_id", (F.col("at") + 1).cast("long").alias("pos"), "item.role", "item.text")


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One formatted text per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` holds the start (from 1) and length, in code points of
    ``formatted``, of every text that ``learn`` says.  Roles and texts are
    escaped, so that control strings in them cannot be taken for the template's;
    null roles and texts count as empty.  A conversation is one output value by
    nature; its turns meet in one row.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit(BODY))
    parts = turns.select("conv_id", "pos", head.alias("head"), text.alias("body"), (F.col("role") == learn).alias("learn"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head") + 1
    parts = parts.withColumn("span", F.when(F.col("learn"), F.struct(start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))))
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "span"))).alias("all"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("all", lambda x: x["span"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: array of struct(role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|start\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(x, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")

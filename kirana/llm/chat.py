r"""Chat formatting by schema fingerprints (operator 13), in DataFrame functions only.

1. A record's nested field paths are listed (``messages[].role``), those that no layout
   knows are left out, and the SHA-256 of the sorted rest is its fingerprint.  Rows of a
   table list the paths of their values that are not null; JSON records list those of
   their own structure.
2. The fingerprint selects one of the declared ``LAYOUTS``, which says where the turns'
   roles and texts stand.  Where no fingerprint fits (a mix of layouts, a row of nulls),
   the first layout whose required paths the record has holds, then the first whose
   required paths its table has; else the record has no layout and no turns.
3. Turns are put in order and written as ``### Role: text</turn>`` and a line end each.
   Escapes make that reversible: ``\`` becomes ``\\``, ``##`` becomes ``#\#`` and ``</``
   becomes ``<\/``, so that no control string is left inside a text.  A loss mask holds,
   for each turn, where its text stands if the model is to learn it.

A conversation is written into one string, so it must fit into one (2 GB).

Defined results: a null text or role is empty; rows of one key are one conversation,
ordered by turn (null last), role and text, repeated rows staying; rows with a null key
are one conversation too; a record that holds whole turns is a conversation of its own,
also where keys repeat; an absent optional part (system) is no turn; fields that no layout
names are ignored; an empty table returns no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
LEARNT = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where a kind of record holds its turns.

    ``each``: an array and the role and text fields of its entries; ``parts``: roles with
    the paths of their texts, joined by line ends; ``place``: the record is one turn, at
    this place of its conversation.  ``roles`` renames roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    key: str = "id"
    each: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    place: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        return (*self.required, *self.optional)


LAYOUTS = (
    Layout("turn_rows", ("turn", "role"), ("conv_id", "text"), key="conv_id", place="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), ("id",), each=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("id",), each=("conversations", "from", "value"),
           roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system"),
           parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt_response", ("prompt", "response"), ("id", "system"),
           parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("id", "system"),
           parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
)


def _digest(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(layouts: tuple[Layout, ...]) -> dict[str, str]:
    """Fingerprint of every path set that a layout allows, and the layout's name."""
    return {_digest((*x.required, *more)): x.name for x in reversed(layouts)
            for n in range(len(x.optional) + 1) for more in combinations(x.optional, n)}


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths})


def _schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.ArrayType):
        return _schema_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in _schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def _listed(schema: Column) -> Column:
    """Paths in a schema string such as ``OBJECT<a: STRING, b: ARRAY<OBJECT<c: BIGINT>>>``."""
    # a field's name, an opening, a closing, or the type of a leaf
    token = r"(`(?:[^`]|``)*`|[^\s:<>,`]+): |(OBJECT<|ARRAY<)|(>)|([A-Z_]+(?:\([0-9, ]*\))?)"
    found = F.regexp_extract_all(schema, F.lit(token), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("paths"), F.lit("").alias("at"))

    def step(state: Column, x: Column) -> Column:
        opened, paths, at = state["open"], state["paths"], state["at"]
        above = F.coalesce(F.try_element_at(opened, F.lit(-1)), F.lit(""))
        name = F.regexp_replace(F.regexp_replace(x, ": $", ""), "^`|`$", "")
        return (F.when(x.endswith(": "), F.struct(opened.alias("open"), paths.alias("paths"),
                                                  F.when(above == "", name).otherwise(F.concat(above, F.lit("."), name)).alias("at")))
                .when(x == "OBJECT<", F.struct(F.array_append(opened, at).alias("open"), paths.alias("paths"), at.alias("at")))
                .when(x == "ARRAY<", F.struct(F.array_append(opened, F.concat(at, F.lit("[]"))).alias("open"), paths.alias("paths"),
                                              F.concat(at, F.lit("[]")).alias("at")))
                .when(x == ">", F.struct(F.slice(opened, F.lit(1), F.greatest(F.size(opened) - 1, F.lit(0))).alias("open"), paths.alias("paths"), at.alias("at")))
                .otherwise(F.struct(opened.alias("open"), F.array_append(paths, at).alias("paths"), at.alias("at"))))

    return F.aggregate(found, start, step, lambda s: s["paths"])


def _selected(paths: Column, layouts: tuple[Layout, ...], table: list[str]) -> Column:
    """Name of the layout: by fingerprint, else by required paths of the record, else of its table."""
    by_hash = F.create_map(*[F.lit(x) for pair in fingerprints(layouts).items() for x in pair])
    out = [F.try_element_at(by_hash, F.sha2(F.array_join(F.array_sort(paths), "\n"), 256))]
    out += [F.when(F.size(F.array_intersect(paths, F.array(*map(F.lit, x.required)))) == len(x.required), F.lit(x.name)) for x in layouts]
    out += [F.lit(x.name) for x in layouts if set(x.required) <= set(table)][:1]
    return F.coalesce(*out)


def _made(layout: Layout, get: Callable[[str, str], Column]) -> Column:
    """The turns of a record as an array of (place, role, text)."""
    def turn(place: Column, role: Column, text: Column) -> Column:
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]), role), role) if layout.roles else role
        return F.struct(place.cast("long").alias("place"), F.coalesce(named, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.place:
        return F.array(turn(get(layout.place, "long"), get("role", "string"), get("text", "string")))
    if layout.each:
        whole, role, text = layout.each
        entries = get(whole, f"array<struct<`{role}`: string, `{text}`: string>>")
        return F.transform(entries, lambda e, k: turn(k, e[role], e[text]))
    turns = []
    for k, (role, paths) in enumerate(layout.parts):
        texts = [get(p, "string") for p in paths]
        said = F.array_join(F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != "")), "\n")
        made = turn(F.lit(k), F.lit(role), said)
        always = any(p in layout.required for p in paths)
        turns.append(made if always else F.when(F.coalesce(*[t.isNotNull() for t in texts]), made))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _turns(records: DataFrame, paths: Column, table: list[str], layouts: tuple[Layout, ...], get: Callable[[str, str], Column], key_type: str, source: str) -> DataFrame:
    named = records.select("*", F.monotonically_increasing_id().alias("_record"), _selected(paths, layouts, table).alias("_layout"))

    def by_layout(make: Callable[[Layout], Column], otherwise: Column) -> Column:
        out = otherwise
        for x in layouts:
            out = F.when(F.col("_layout") == x.name, make(x)).otherwise(out)
        return out

    whole = [x.name for x in layouts if not x.place]
    return named.select(
        by_layout(lambda x: get(x.key, key_type), F.lit(None).cast(key_type)).alias("conv_id"),
        F.when(F.col("_layout").isin(whole) | F.col("_layout").isNull(), F.concat(F.lit(f"{source}/"), F.col("_record"))).alias("record"),
        F.col("_layout").alias("layout"),
        by_layout(lambda x: _made(x, get), F.array().cast("array<struct<place:bigint,role:string,text:string>>")).alias("turns"))


def turns_of_rows(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, key_type: str = "long", source: str = "rows") -> DataFrame:
    """``conv_id``, ``record``, ``layout`` and ``turns`` of a table's rows; ``record`` is null where a row is a turn."""
    there = set(_schema_paths(rows.schema))
    own = [p for p in _known(layouts) if p in there]
    usable = tuple(x for x in layouts if set(x.required) <= there)
    kinds = {f.name: f.dataType for f in rows.schema}

    def get(path: str, kind: str) -> Column:
        if path not in kinds:
            return F.lit(None).cast(kind)
        if kind.startswith("array"):
            names = [f.strip().split("`")[1] for f in kind[len("array<struct<"):-2].split(",")]
            return F.transform(F.col(f"`{path}`"), lambda e: F.struct(*[e[n].cast("string").alias(n) for n in names]))
        return F.col(f"`{path}`").cast(kind)

    present = [F.when(F.col(f"`{p.split('[')[0].split('.')[0]}`").isNotNull(), F.lit(p)) for p in own]
    paths = F.array_compact(F.array(*present)) if present else F.array().cast("array<string>")
    return _turns(rows, paths, own, usable, get, key_type, source)


def turns_of_json(records: DataFrame, json: str = "json", layouts: tuple[Layout, ...] = LAYOUTS, key_type: str = "long", source: str = "json") -> DataFrame:
    """The same of JSON records; text that is no JSON has no layout."""
    parsed = records.select(F.try_parse_json(json).alias("_value"))
    paths = F.array_intersect(F.coalesce(_listed(F.schema_of_variant("_value")), F.array().cast("array<string>")), F.array(*map(F.lit, _known(layouts))))

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("_value"), f"$['{path}']", kind)

    return _turns(parsed, paths, [], layouts, get, key_type, source)


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=#)", r"#\\")
    return F.replace(text, F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _label(role: Column) -> Column:
    """The three usual roles by their names, any other after ``=``."""
    usual = role.isin("system", "user", LEARNT)
    return F.when(usual, F.initcap(role)).otherwise(F.concat(F.lit("="), F.replace(escaped(role), F.lit(":"), F.lit("\\:"))))


def formatted(turns: DataFrame) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``layout``, ``n_turns``, ``formatted`` and ``loss``.

    ``loss`` has an entry for each turn: where the turn starts, and start and end of its
    text if it is learnt (else null), in code points of ``formatted``.
    """
    each = turns.select("conv_id", "record", "layout", F.explode_outer("turns").alias("t")).select("conv_id", "record", "layout", "t.*")
    head = F.when(F.col("text").isNotNull(), F.concat(F.lit("### "), _label(F.col("role")), F.lit(": ")))
    each = each.withColumn("head", F.coalesce(head, F.lit(""))).withColumn("body", escaped(F.col("text")))
    each = each.withColumn("piece", F.coalesce(F.concat("head", "body", F.lit(END)), F.lit("")))
    order = Window.partitionBy("conv_id", "record").orderBy(F.col("place").asc_nulls_last(), "role", "text")
    each = (each.withColumn("nth", F.row_number().over(order))
            .withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    start = F.col("at") + F.char_length("head")
    mask = F.when(F.col("role") == LEARNT, F.struct(F.col("at").alias("turn"), start.alias("start"), (start + F.char_length("body")).alias("end")))
    each = each.select("conv_id", "record", "layout", F.struct("nth", "piece", mask.alias("mask")).alias("t"), (F.col("piece") != "").cast("long").alias("is_turn"))
    whole = each.groupBy("conv_id", "record").agg(F.first("layout").alias("layout"), F.sum("is_turn").alias("n_turns"), F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", "layout", "n_turns", F.array_join(F.col("t.piece"), "").alias("formatted"),
                        F.when(F.col("n_turns") > 0, F.col("t.mask")).otherwise(F.array().cast("array<struct<turn:bigint,start:bigint,end:bigint>>")).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """The formatted conversations with ``turns`` (role, text) and ``learnt`` texts, read from ``formatted`` and ``loss`` alone."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"

    def turn(piece: Column) -> Column:
        label = unescaped(F.regexp_extract(piece, head, 1))
        role = F.when(label.startswith("="), F.substring(label, F.lit(2), F.char_length(label))).otherwise(F.lower(label))
        return F.struct(role.alias("role"), unescaped(F.regexp_extract(piece, head, 2)).alias("text"))

    def learnt(piece: Column, mask: Column) -> Column:
        return unescaped(F.substring(piece, (mask["start"] - mask["turn"] + 1).cast("int"), (mask["end"] - mask["start"]).cast("int")))

    return chats.select("*", F.transform(pieces, turn).alias("turns"),
                        F.filter(F.zip_with(pieces, F.col("loss"), learnt), lambda t: t.isNotNull()).alias("learnt"))

"""Operator 2: canonical turns from records of different layouts, and their chat template. Columns only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"

#: A JSON string may be as long as a string can be.
JSON = {"maxStringLen": "2147483647"}


@dataclass(frozen=True)
class Layout:
    """How one kind of record maps to turns.

    Either `items` names a list of objects with a `role` and a `text` field, or `fields` gives (role, paths) for
    each turn, whose non-empty values are joined by an empty line. `optional` paths may be absent."""

    name: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    also: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    renames: bool = True  # whether its roles go by other names than the canonical ones (ROLES)

    def required(self) -> frozenset[str]:
        if self.items:
            return frozenset([self.items, *(f"{self.items}[].{x}" for x in (self.role, self.text, *self.also))])
        return frozenset(p for _, paths in self.fields for p in paths) - frozenset(self.optional)

    def path_sets(self) -> list[frozenset[str]]:
        """Every set of known paths that a record of this layout may have."""
        extra = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        whole = [self.required() | frozenset(x) for x in extra]
        return whole + ([frozenset([self.items])] if self.items else [])  # an empty list has no paths below


LAYOUTS = (
    Layout("turns", items="turns", role="role", text="text", also=("turn",), renames=False),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("conversations", items="conversations", role="from", text="value"),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
           optional=("system", "input")),
    Layout("completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
           optional=("system",)),
    Layout("question", fields=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)

#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(record: Column, containers: list[str]) -> Column:
    """Nested paths of a JSON object: its fields, and `list[].field` for the objects in its lists `containers`."""
    top = F.from_json(record, "map<string,string>", JSON)
    nested = [F.transform(F.array_distinct(F.flatten(F.transform(
        F.filter(F.from_json(top[c], "array<map<string,string>>", JSON), lambda x: x.isNotNull()), F.map_keys))),
        lambda k, c=c: F.concat(F.lit(f"{c}[]."), k)) for c in containers]
    return F.concat(F.map_keys(top), *[F.coalesce(x, F.array().cast("array<string>")) for x in nested])


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def escaped(text: Column, role: bool = False) -> Column:
    """Backslash becomes \\s, and `<|` becomes `<\\|`; a role's line feed becomes \\n. No control string is left."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def _turns(record: Column, layout: Layout) -> Column:
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.items:
        kind = f"struct<`{layout.items}`:array<struct<`{layout.role}`:string,`{layout.text}`:string>>>"
        items = F.from_json(record, kind, JSON)[layout.items]
        named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        role = lambda x: F.coalesce(F.try_element_at(named, F.coalesce(x, F.lit(""))), x) if layout.renames else x
        return F.transform(F.coalesce(items, F.array().cast(f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")),
                           lambda x: turn(role(x[layout.role]), x[layout.text]))
    names = dict.fromkeys(p for _, paths in layout.fields for p in paths)
    values = F.from_json(record, ",".join(f"`{p}` string" for p in names), JSON)
    told = [turn(F.lit(role), F.array_join(F.filter(F.array(*[values[p] for p in paths]), lambda x: x != ""), "\n\n"))
            for role, paths in layout.fields]
    return F.filter(F.array(*told), lambda t: (t["text"] != "") | (t["role"] != "system"))


def canonical(df: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds `layout` and `turns` (role, text) to records given as JSON objects.

    The known paths of a record, sorted and hashed, are its fingerprint; it selects the mapping that turns the
    record into canonical turns. Fields that no layout knows do not count. A record of no known layout (also null
    or no JSON object) keeps its row with null `layout` and `turns`. Null roles and texts become empty. Columns of
    the input named like the added ones are replaced."""
    known = sorted({p for layout in layouts for paths in layout.path_sets() for p in paths})
    containers = sorted({layout.items for layout in layouts if layout.items})
    record = F.col(record_col)
    paths = F.array_intersect(field_paths(record, containers), F.array(*map(F.lit, known)))
    own = "_fingerprint" + "_" * max(map(len, df.columns))  # a name that no column has
    chosen, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for layout in reversed(layouts):
        prints = [fingerprint(F.array(*map(F.lit, sorted(paths)))) for paths in layout.path_sets()]
        match = F.col(own).isin(*prints)
        chosen, name = F.when(match, _turns(record, layout)).otherwise(chosen), F.when(match, layout.name).otherwise(name)
    return df.withColumn(own, fingerprint(paths)).withColumns({"layout": name, "turns": chosen}).drop(own)


def templated(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds `segments` (text, loss) and `formatted`, their texts joined, to canonical `turns`.

    Each turn is START, role, a line feed, the text, END; texts and roles are escaped, so that neither holds a
    control string. The loss mask covers just the texts of `loss_roles`. Null turns give null."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        piece(F.concat(F.lit(START), escaped(t["role"], role=True), F.lit("\n")), F.lit(False)),
        piece(escaped(t["text"]), t["role"].isin(*loss_roles)),
        piece(F.lit(END), F.lit(False)))))
    return df.withColumn("segments", segments).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: the inverse of `templated`."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.replace(p, F.lit(START), F.lit("")), "\n", 1)).alias("role"),
        unescaped(F.replace(p, F.lit(START), F.lit("")).substr(
            F.length(F.substring_index(F.replace(p, F.lit(START), F.lit("")), "\n", 1)) + 2, F.length(p))).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def records_of(rows: DataFrame) -> DataFrame:
    """One JSON record per `conv_id` from rows (conv_id, turn, role, text), turns in order (ties by role and text,
    nulls first; repeated rows are turns of their own; rows without id are one conversation). Conversations are
    training examples: one must fit a row."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", _as_json(F.struct("turns")).alias("record"))


def _as_json(record: Column) -> Column:
    return F.to_json(record, {"ignoreNullFields": "false"})


def mixed_records_of(rows: DataFrame) -> DataFrame:
    """Like `records_of`, but in several layouts: a hash of the id chooses one, where the conversation can be told in it (its roles
    are the canonical ones; for a prompt and a response, there is one of each and no empty text). Others have `turns`."""
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    plain = F.forall("turns", lambda t: F.coalesce(t["role"].isin("system", "user", "assistant"), F.lit(False)))
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), " ")
    short = plain & roles.isin("user assistant", "system user assistant") & F.forall("turns", lambda t: F.coalesce(t["text"], F.lit("")) != "")
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    foreign = F.create_map(*[F.lit(x) for pair in (("user", "human"), ("assistant", "gpt"), ("system", "system")) for x in pair])
    said = F.transform("turns", lambda t: F.struct(F.try_element_at(foreign, t["role"]).alias("from"), t["text"].alias("value")))
    of = lambda role: F.get(F.filter("turns", lambda t: t["role"] == role), F.lit(0))["text"]
    choice = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    record = (F.when(plain & (choice == 1), _as_json(F.struct(messages.alias("messages"))))
              .when(plain & (choice == 2), _as_json(F.struct(said.alias("conversations"))))
              .when(short & (choice == 3), _as_json(F.struct(of("system").alias("system"), of("user").alias("prompt"), of("assistant").alias("response"))))
              .otherwise(_as_json(F.struct("turns"))))
    return whole.select("conv_id", record.alias("record"))


#: The digests of `op2` as SQL, from the definition of the template.
CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                                  (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(replace(replace(replace(role, '\', '\s'), '<|', '<\|'), chr(10), '\n')) + 1
                + length(replace(replace(text, '\', '\s'), '<|', '<\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

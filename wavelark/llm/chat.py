"""Chat formatting of records in many layouts, in DataFrame functions only.

A record is JSON. Its nested field paths, from the schema of the value, are
cut to those that some mapping names, and their hash, the fingerprint, selects
the mapping. A mapping says where the turns are: fields of one turn each, or a
list with a role and a text field per element. All become canonical turns of a
role and a text, which the template writes as one text with a loss mask.

The template ends a turn with `</turn>` and begins it with `### Role: `. Inside
texts a backslash goes before a backslash, before the second of two `#` and
before the slash of `</turn>`, so neither mark can occur there; roles have
those signs as percent codes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
SPAN = "struct<start:long,stop:long>"
END = "</turn>"
#: Roles that the template writes as a title; any other gets "=" before it.
TITLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_CODES = {"%": "%25", ":": "%3A", "#": "%23", "<": "%3C"}


@dataclass(frozen=True)
class Mapping:
    """Where one layout has its turns.

    fields: (path, role) of the fields that are a turn each, in order; those in
    `optional` may be absent. Or `turns`: the path of a list whose elements have
    the fields `role` and `text`; `renamed` says what a role's name stands for.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    turns: str = ""
    role: str = "role"
    text: str = "content"
    renamed: tuple[tuple[str, str], ...] = ()

    def layouts(self) -> list[frozenset[str]]:
        """The sets of paths that a record of this layout can have."""
        if self.turns:
            return [frozenset({f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}), frozenset({f"{self.turns}[]"})]
        always = {p for p, _ in self.fields} - set(self.optional)
        return [frozenset(always | set(some)) for n in range(len(self.optional) + 1) for some in itertools.combinations(self.optional, n)]


MAPPINGS = (
    Mapping("messages", turns="messages"),
    Mapping("shared", turns="conversations", role="from", text="value", renamed=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("output", "assistant")), optional=("system",)),
    Mapping("nested", fields=(("data.system", "system"), ("data.question", "user"), ("data.answer", "assistant")), optional=("data.system",)),
)

_TOKEN = r"`(?:[^`]|``)*`: |[^\s`<>,:()]+: |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9, ]*\))?"


def paths(record: Column) -> Column:
    """The nested field paths of a JSON text, `a.b` and `a[].b` for elements of
    a list, ascending; null if it is no JSON."""
    tokens = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(record)), F.lit(_TOKEN), F.lit(0))
    zero = F.struct(F.array(F.lit("")).alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        # the stack holds the paths of what is open: an object's with a dot at
        # its end, and a name's until its value has been read
        put = lambda path: F.struct(F.array_append(acc["stack"], path).alias("stack"), acc["out"].alias("out"))
        less = lambda n: F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - n, F.lit(1)))
        top = F.element_at(acc["stack"], -1)
        within = (top == "") | F.endswith(top, F.lit("."))
        name = F.regexp_replace(token, "^`|`?: $", "")
        for sign, code in (("``", "`"), (".", "%2E"), ("[", "%5B")):
            name = F.replace(name, F.lit(sign), F.lit(code))
        return (
            F.when(F.endswith(token, F.lit(": ")), put(F.concat(top, name)))
            .when(token == "OBJECT<", put(F.when(top == "", "").otherwise(F.concat(top, F.lit(".")))))
            .when(token == "ARRAY<", put(F.concat(top, F.lit("[]"))))
            .when(token == ">", F.struct(F.when(within, less(2)).otherwise(less(1)).alias("stack"), acc["out"].alias("out")))
            .otherwise(F.struct(less(1).alias("stack"), F.array_append(acc["out"], top).alias("out")))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, zero, step)["out"]))


def fingerprint(found: Column) -> Column:
    """The hash of paths, ascending ones."""
    return F.xxhash64(F.array_join(found, "\n"))


def _turns(mapping: Mapping, value: Column, found: Column) -> Column:
    if mapping.turns:
        kind = f"array<struct<{mapping.role}:string,{mapping.text}:string>>"
        role = lambda e: F.coalesce(e[mapping.role], F.lit(""))

        def renamed(name: Column) -> Column:
            for old, new in mapping.renamed:
                name = F.when(name == old, F.lit(new)).otherwise(name)
            return name

        held = F.try_variant_get(value, f"$.{mapping.turns}", kind)
        turns = F.transform(held, lambda e: F.struct(renamed(role(e)).alias("role"), F.coalesce(e[mapping.text], F.lit("")).alias("text")))
        return F.when(F.forall(held, lambda e: e.isNotNull()), turns)
    each = []
    for path, role in mapping.fields:
        turn = F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(value, f"$.{path}", "string"), F.lit("")).alias("text"))
        each.append(F.when(F.array_contains(found, path), turn) if path in mapping.optional else turn)
    return F.filter(F.array(*each), lambda t: t.isNotNull())


def canonical(records: DataFrame, record_col: str = "record", mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout and turns (array of role, text).

    layout is the mapping's name; it and turns are null for a record that no
    mapping fits: no JSON (a null or empty text too, or more than Spark's 128
    MiB of a variant), other or too few fields, those of two mappings, or a list
    whose elements are no objects. Its row stays, with a null fingerprint for no
    JSON. Fields that no mapping names don't matter. A null role or text is
    empty; numbers are their text. Repeated records get equal rows. Columns of
    records with the new names give way.
    """
    mappings = tuple(mappings)
    layouts = [(m, layout) for m in mappings for layout in m.layouts()]
    if len({layout for _, layout in layouts}) < len(layouts):
        raise ValueError("two mappings have a layout in common")
    known = sorted({p for _, layout in layouts for p in layout})
    own = [c for c in records.columns if c.lower() not in ("fingerprint", "layout", "turns")]
    text = F.col(record_col).cast("string")
    rows = records.select(*own, F.try_parse_json(text).alias("value of it"), F.array_intersect(paths(text), F.array(*map(F.lit, known))).alias("paths of it"))
    rows = rows.withColumn("fingerprint of it", fingerprint(F.array_sort("paths of it")))
    rows = rows.withColumn("fingerprint of it", F.when(F.col("paths of it").isNotNull(), F.col("fingerprint of it")))
    selected, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for mapping in mappings:
        marks = [fingerprint(F.array(*map(F.lit, sorted(layout)))) for m, layout in layouts if m is mapping]
        fits = F.col("fingerprint of it").isin(*marks)
        selected = F.when(fits, F.lit(mapping.name)).otherwise(selected)
        turns = F.when(fits, _turns(mapping, F.col("value of it"), F.col("paths of it"))).otherwise(turns)
    rows = rows.select(*own, F.col("fingerprint of it").alias("fingerprint"), selected.alias("layout of it"), turns.alias("turns"))
    return rows.select(*own, "fingerprint", F.when(F.col("turns").isNotNull(), F.col("layout of it")).alias("layout"), "turns")


def escaped(text: Column) -> Column:
    for sign, code in (("\\", "\\\\"), ("##", "#\\#"), (END, "<\\/turn>")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _title(role: Column) -> Column:
    other = role
    for sign, code in _CODES.items():
        other = F.replace(other, F.lit(sign), F.lit(code))
    out = F.concat(F.lit("="), other)
    for name, title in TITLES.items():
        out = F.when(role == name, F.lit(title)).otherwise(out)
    return out


def _role(title: Column) -> Column:
    other = F.substring(title, F.lit(2), F.length(title))
    for sign, code in reversed(_CODES.items()):
        other = F.replace(other, F.lit(code), F.lit(sign))
    for name, own in TITLES.items():
        other = F.when(title == own, F.lit(name)).otherwise(other)
    return other


def formatted(rows: DataFrame, turns_col: str = "turns", learned: str = "assistant") -> DataFrame:
    """rows with formatted, the turns as one text, and loss, the spans of the
    escaped texts of role `learned` in it (code points, end exclusive).

    Null turns give null; no turns give an empty text without spans; an empty
    text is a span of no length. A record's turns must fit a row of Spark.
    """
    own = [c for c in rows.columns if c.lower() not in ("formatted", "loss")]
    piece = lambda t: F.struct(F.concat(F.lit("### "), _title(t["role"]), F.lit(": ")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learned).alias("learned"))
    rows = rows.select(*own, F.transform(turns_col, piece).alias("pieces of it"))
    text = F.array_join(F.transform("pieces of it", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        return F.struct((stop + len(END) + 1).cast("long").alias("at"), F.when(p["learned"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return rows.select(*own, text.alias("formatted"), F.aggregate("pieces of it", zero, step)["out"].alias("loss"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(text, f"{END}\n", -1)
    turn = lambda p: F.struct(_role(F.substring(p, F.lit(5), F.locate(":", p) - 5)).alias("role"), unescaped(F.substring(p, F.locate(":", p) + 2, F.length(p))).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped. Spans are taken in order while
    turns are, so a long text is gone through once, not once a span."""
    parts = F.split(text, f"{END}\n", -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), loss.alias("spans"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        stop = acc["at"] + F.length(part)
        span = F.get(acc["spans"], acc["n"])
        held = F.coalesce(span["stop"] == stop, F.lit(False))
        own = unescaped(F.substring(part, (span["start"] - acc["at"] + 1).cast("int"), F.length(part)))
        return F.struct((stop + len(END) + 1).cast("long").alias("at"), F.when(held, acc["n"] + 1).otherwise(acc["n"]).alias("n"), acc["spans"].alias("spans"), F.when(held, F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(text.isNotNull(), F.array_join(F.aggregate(parts, zero, step)["out"], ""))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) out of rows of conv_id, turn, role, text, a JSON text
    for each conversation, in the layout that a rule picks: a question and an
    answer, with a system text or without, are fields (conv_id even: of the
    record, odd: below `data`), other conversations lists (odd ones of users and
    assistants only: `conversations`, the rest: `messages`).

    Rows go by turn (nulls first), equal turns by role and text; a null role or
    text is empty. A conversation must fit a row of Spark.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    roles = F.array_join(F.transform("rows", lambda t: t["role"]), ",")
    odd = F.coalesce(F.col("conv_id") % 2 != 0, F.lit(False))
    text = lambda n: F.get("rows", F.lit(n))["text"]
    plain = F.forall("rows", lambda t: t["role"].isin("user", "assistant"))
    share = lambda t: F.struct(F.when(t["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")).alias("from"), t["text"].alias("value"))
    pair, triple = (roles == "user,assistant") & (F.size("rows") == 2), (roles == "system,user,assistant") & (F.size("rows") == 3)
    record = (
        F.when(pair & odd, F.to_json(F.struct(F.struct(text(0).alias("question"), text(1).alias("answer")).alias("data"))))
        .when(pair, F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(triple & odd, F.to_json(F.struct(F.struct(text(0).alias("system"), text(1).alias("question"), text(2).alias("answer")).alias("data"))))
        .when(triple, F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(plain & odd, F.to_json(F.struct(F.transform("rows", share).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    )
    return held.select("conv_id", record.alias("record"))

"""Information-theoretic sanitisation, in DataFrame operations only.

Patterns find the protected entities (addresses, cards, phone numbers). How
strongly a term reveals an entity is estimated from the corpus: with n the
rows that hold both, the pointwise mutual information log(N n / (df_t df_e))
as a share of the entity's own information log(N / df_e). A term whose share
reaches DISCLOSES is generalised to a placeholder in rows that hold the
entity; one whose share reaches REVEALS is removed. A pair seen in one row only
is judged by the other rows, none of which holds both: it tells nothing there.
So pairs, and with them entities and terms, count from SUPPORT rows on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SUPPORT = 2
DISCLOSES = 0.75
REVEALS = 0.95

#: Possessive forms of the patterns, which match alike and take linear time: a
#: run that fails from its start fails from everywhere in it. \G lets a match
#: begin where the one before ended.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it has no match, which is quicker to see.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_EDGES = ".,;:!?()[]{}<>\"'|*#&%$"
_SPAN = "struct<kind:int,start:long,stop:long,value:string>"


def _holds(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def _spans(number: int, kind: str, hits: Column, gaps: Column) -> Column:
    """The kind's spans, in code points, from its matches and what lies
    between them."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(number).alias("kind"), start.alias("start"), stop.alias("stop"), x["hit"].alias("value"))
        keep = x["hit"].isNotNull() & _holds(kind, x["hit"])
        return F.struct(stop.cast("long").alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast(f"array<{_SPAN}>"))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text, email, ip, card, phone): per document the spans of each
    kind; text is kept where there are any. row numbers the documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in KINDS.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"{kind}_hits", F.when(F.contains("text", F.lit(NEEDS[kind])), hits).otherwise(none) if kind in NEEDS else hits)
    for kind, pattern in KINDS.items():
        rows = rows.withColumn(f"{kind}_gaps", F.when(F.size(f"{kind}_hits") > 0, F.split("text", pattern, -1)).otherwise(none))
    spans = [_spans(n, kind, F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")).alias(kind) for n, kind in enumerate(KINDS)]
    rows = rows.select("id", "text", *spans)
    some = reduce(lambda a, b: a | b, [F.size(kind) > 0 for kind in KINDS])
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.when(some, F.col("text")).alias("text"), *KINDS)


def _word(token: Column) -> Column:
    """The term that a blank-separated token stands for."""
    return F.lower(F.btrim(token, F.lit(_EDGES)))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[\\x20\\x09-\\x0D]+"), _word), lambda w: F.length(w) > 0))


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, term, share): the terms that disclose an entity of their row, with
    the largest share of an entity's information that they tell there."""
    values = F.array_distinct(F.transform(F.concat(*KINDS), lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), s["value"])))
    held = found.where(F.col("text").isNotNull()).select("row", F.explode(values).alias("entity"))
    often = held.groupBy("entity").agg(F.count("*").alias("df_e")).where(F.col("df_e") >= SUPPORT)
    kept = held.join(often, "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "df_e")).alias("entities"))
    texts = staged(kept.join(found.select("row", "text", *KINDS), "row"), "protected")
    inside = F.array_distinct(F.transform(F.concat(*KINDS), lambda s: _word(s["value"])))
    terms = texts.select("row", "entities", F.explode(F.array_except(_words(F.col("text")), inside)).alias("term"))
    pairs = terms.select("row", "term", F.explode("entities").alias("e")).select("row", "term", "e.entity", "e.df_e")
    together = staged(pairs.groupBy("entity", "term").agg(F.count("*").alias("n"), F.first("df_e").alias("df_e")).where(F.col("n") >= SUPPORT), "together")
    asked = together.select("term").distinct()
    seen = docs.select(F.explode(_words(F.col(text_col).cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")).where(F.col("df_t") >= SUPPORT)
    total = float(max(1, found.count()))
    mutual = F.log(total * F.col("n") / (F.col("df_t") * F.col("df_e")))
    own = F.log(total / F.col("df_e"))
    strong = together.join(seen.join(asked, "term", "left_semi"), "term").where((own > 0) & (mutual >= DISCLOSES * own))
    strong = strong.select("entity", "term", (mutual / own).alias("share"))
    return pairs.select("row", "entity", "term").join(strong, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))


def _term_spans(text: Column, told: Column, base: Column) -> Column:
    """Spans of the tokens whose term is told, outside the base spans."""
    known = F.transform(told, lambda t: t["term"])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        bare = F.ltrim(token, F.lit(_EDGES))
        start = acc["at"] + F.length(token) - F.length(bare)
        stop = start + F.length(F.rtrim(bare, F.lit(_EDGES)))
        span = F.struct(F.lit(len(KINDS)).alias("kind"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), _word(token).alias("value"))
        free = ~F.exists(base, lambda b: (b["start"] < stop) & (start < b["stop"]))
        keep = (F.length(token) > 0) & F.array_contains(known, _word(token)) & free
        return F.struct((acc["at"] + F.length(token) + 1).cast("long").alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(text, "[\\x20\\x09-\\x0D]", -1), zero, step)["out"]


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    sanitised (the text with entities and terms replaced; null where nothing
    was found).

    A null text is as an empty one: no spans. Every row counts as a document,
    repeated rows too. Rows without an id are treated alike.
    """
    found = staged(entities(docs, id_col, text_col), "entities")
    told = disclosing(found, docs, text_col).groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("told"))
    more = found.join(told, "row").select("row", "told", _term_spans(F.col("text"), F.col("told"), F.concat(*KINDS)).alias("terms"))
    rows = found.join(more, "row", "left")
    base = F.concat(*KINDS)
    spans = F.concat(base, F.coalesce(F.col("terms"), F.array().cast(f"array<{_SPAN}>")))

    # the base spans of one text may overlap across kinds: the first one counts
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    label = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    removed = F.transform(F.filter("told", lambda t: t["share"] >= REVEALS), lambda t: t["term"])

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["kind"] < len(KINDS), F.get(label, s["kind"])).when(F.array_contains(removed, s["value"]), F.lit("")).otherwise(F.lit("[term]"))
        between = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], between, put).alias("out")))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"))))
    done = F.aggregate(ordered, zero, step)
    rows = rows.select("*", done.alias("done"))
    rest = F.substring(F.col("text"), (F.col("done.at") + 1).cast("int"), F.length("text"))
    clean = F.when(F.col("text").isNotNull(), F.concat(F.col("done.out"), rest))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"), clean.alias("sanitised"))

"""Repair of conversations at least cost, by dynamic programming over tensors.

Faults are found by Spark, and each conversation becomes a string of one code
per row. An Arrow UDF takes these strings: conversations of like length form a
tensor with the turn as its first axis, the least costs of all their states are
updated turn by turn from the end, stored, and the edits traced from the start,
again for all of them at once. Texts don't enter Python.

States are what the role that was written last lets follow: nothing yet, after
the system's, after a user's, after an assistant's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells (turns x conversations) of one tensor, beyond a single conversation.
CELLS = 1 << 20
FAR = 1 << 40
DELETE, REROLE, INSERT, UNTRUNCATED = 2, 1, 5, 5
#: A row's role initial, in capitals if it is truncated; "d" must be deleted.
CODES = "suaxSUAXd"
PAD = len(CODES)
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the role that a state makes or inserts.
FOLLOWS = np.array([USER, USER, ASSISTANT, USER])
ENDS = np.array([0, FAR, FAR, 0], np.int64)
EDIT = "struct<source:int,role:string>"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code and state: the cost of keeping the row and the state after it,
    and per code the cost of giving it another role."""
    keep, after, rerole = np.full((PAD + 1, 4), FAR, np.int64), np.zeros((PAD + 1, 4), np.int64), np.full(PAD + 1, FAR, np.int64)
    for n, code in enumerate(CODES[:-1]):
        more = UNTRUNCATED * code.isupper()
        rerole[n] = REROLE + more
        for state in range(4):
            if code.lower() == "ua"[int(FOLLOWS[state] == ASSISTANT)]:
                keep[n, state], after[n, state] = more, FOLLOWS[state]
        if code.lower() == "s":
            keep[n, START], after[n, START] = more, SYSTEM
    return keep, after, rerole


KEEP, AFTER, REROLED = _tables()


def edits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest edits of conversations of codes, an array of turns x
    conversations with PAD behind the shorter ones: (cost, letter, state).

    letter and state have the axes turn, step and conversation: up to three
    inserts before a turn and then what becomes of its row (0: nothing), and the
    state after it. The last turn stands for the end. Of equally cheap edits
    those whose letters come first.
    """
    turns, count = codes.shape
    cost = np.empty((turns + 1, 4, count), np.int64)

    def inserted(row: np.ndarray) -> None:
        for _ in range(3):
            np.minimum(row, INSERT + row[FOLLOWS], out=row)

    cost[turns] = ENDS[:, None]
    inserted(cost[turns])
    every = np.arange(count)
    for t in range(turns - 1, -1, -1):
        code, later, row = codes[t], cost[t + 1], cost[t]
        row[:] = np.where(code == PAD, later, DELETE + later)
        for state in range(4):
            kept = KEEP[code, state] + later[AFTER[code, state], every]
            np.minimum(row[state], np.minimum(kept, REROLED[code] + later[FOLLOWS[state]]), out=row[state])
        inserted(row)
    letter = np.zeros((turns + 1, 4, count), np.uint8)
    states = np.zeros((turns + 1, 4, count), np.int8)
    state = np.zeros(count, np.int64)
    for t in range(turns + 1):
        code = codes[t] if t < turns else np.full(count, PAD)
        later = cost[t + 1] if t < turns else cost[turns]
        moving = code != PAD
        # conversations that still insert before this row
        asking = np.ones(count, bool) if t == turns else moving.copy()
        for step in range(4):
            now = cost[t, state, every]
            dropped = moving & asking & (DELETE + later[state, every] == now)
            into = asking & ~dropped & (now > 0) & (INSERT + cost[t, FOLLOWS[state], every] == now)
            rest = moving & asking & ~dropped & ~into
            kept = rest & (KEEP[code, state] + later[AFTER[code, state], every] == now)
            letter[t, step] = np.where(dropped, ord("D"), np.where(into, ord("I"), np.where(kept, ord("K"), np.where(rest, ord("R"), 0))))
            state = np.where(kept, AFTER[code, state], np.where(into | (rest & ~kept), FOLLOWS[state], state))
            states[t, step] = state
            asking = into
            if not asking.any():
                break
    return cost[0, START], letter, states


def plans(strings: pa.Array) -> pa.Array:
    """Per code string a struct of cost, audit (the edits' letters) and edits,
    one for each row of the repaired conversation: source, the number of the row
    that it comes from (null: inserted), and role, its new role (null: kept)."""
    lengths = np.array([len(x) for x in strings.to_pylist()], np.int64)
    flat = np.frombuffer("".join(strings.to_pylist()).encode(), np.uint8)
    number = np.zeros(256, np.int64)
    number[np.frombuffer(CODES.encode(), np.uint8)] = np.arange(len(CODES))
    flat, begins = number[flat], np.cumsum(lengths) - lengths
    cost = np.zeros(len(lengths), np.int64)
    audits: list[bytes] = [b""] * len(lengths)
    made: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(lengths)
    # buckets: lengths up to the next power of two, cut by cells
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        members = members[np.argsort(lengths[members], kind="stable")]
        per = max(1, CELLS >> int(b))
        for part in (members[i : i + per] for i in range(0, len(members), per)):
            turns = int(lengths[part].max())
            codes = np.full((turns, len(part)), PAD)
            own = lengths[part]
            column = np.repeat(np.arange(len(part)), own)
            row = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            codes[row, column] = flat[np.repeat(begins[part], own) + row]
            cost[part], letter, states = edits(codes)
            for at, letters, after in zip(part.tolist(), letter.transpose(2, 0, 1), states.transpose(2, 0, 1), strict=True):
                turn, step = np.nonzero(letters)
                written = letters[turn, step]
                audits[at] = written.tobytes()
                out = written != ord("D")
                source = np.where(written[out] == ord("I"), -1, turn[out])
                made[at] = source, np.where(written[out] == ord("K"), 0, after[turn, step][out])
    sizes = np.cumsum([0, *[len(s) for s, _ in made]])
    source = np.concatenate([s for s, _ in made]) if made else np.zeros(0, np.int64)
    role = np.concatenate([r for _, r in made]) if made else np.zeros(0, np.int64)
    roles = pa.array([None, None, "user", "assistant"]).take(pa.array(role))
    each = pa.StructArray.from_arrays([pa.array(source, pa.int32(), mask=source < 0), roles], ["source", "role"])
    return pa.StructArray.from_arrays([pa.array(cost), pa.array([a.decode() for a in audits], pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)], ["cost", "audit", "edits"])


def _code(row: Column) -> Column:
    initial = F.substring(row["role"], F.lit(1), F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(row["fault"].isin("blank", "duplicate"), "d").when(row["fault"] == "truncated", F.upper(initial)).otherwise(initial)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", lost_col: str | None = None) -> DataFrame:
    """Per conversation: its id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired (array of role, text).

    Rows go by turn, nulls first; rows of one turn by role and text. A null role
    or text is one space. A row's first fault counts: blank (nothing but the six
    ASCII blanks), duplicate (role and text of an earlier row, so a repeated
    row), truncated (the last other character is none of . ! ?). gaps counts the
    turns that lack between the least and the largest. illegal counts pairs of
    neighbours whose role initials are not su, ua or au.

    Edits lead to role initials (s?(ua)+)? at least cost: Keep 0, Rerole to user
    or assistant 1, Delete 2 (a must for blank and duplicate rows), Insert an
    empty user's or assistant's row 5; a truncated row that isn't deleted adds
    5. Of equal ones the audit that is least in ASCII counts.

    Rows without an id are one conversation. A row whose lost_col is true only
    names its conversation; one that has no others gets zeros, an empty audit
    and no rows. A conversation must fit a row of Spark, its codes and costs (40
    bytes a row) a task of Python.
    """
    lost = F.coalesce(F.col(lost_col), F.lit(False)) if lost_col else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"), lost.alias("lost"))
    rows = rows.repartition("id")  # the window and the groups share this exchange
    time = F.row_number().over(Window.partitionBy("id", "role", "text", "lost").orderBy(F.asc_nulls_first("turn")))
    held = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(held == "", "blank").when(F.col("time") > 1, "duplicate").when(~F.substring(held, -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("time", time).select("id", "lost", F.struct("turn", "role", "text", "time", fault.alias("fault")).alias("row"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(~F.col("lost"), F.col("row")))).alias("rows"))
    whole = whole.select("id", "rows", F.array_join(F.transform("rows", _code), "").alias("codes"))
    planned = F.arrow_udf(plans, f"struct<cost:long,audit:string,edits:array<{EDIT}>>")
    done = whole.select("id", "rows", planned("codes").alias("plan"))

    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))
    count = lambda kind: F.size(F.filter("rows", lambda r: r["fault"] == kind)).cast("long").alias(kind)
    initials = F.transform("rows", lambda r: F.substring(r["role"], F.lit(1), F.lit(1)))
    beside = F.zip_with(F.slice(initials, F.lit(1), F.greatest(F.size("rows") - 1, F.lit(0))), F.slice(initials, F.lit(2), F.size("rows")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(beside, lambda p: ~p.isin("su", "ua", "au")))
    row = lambda e: F.get("rows", e["source"])
    repaired = F.transform("plan.edits", lambda e: F.struct(F.coalesce(e["role"], row(e)["role"]).alias("role"), F.coalesce(row(e)["text"], F.lit("")).alias("text")))
    return done.select(
        F.col("id").alias(id_col),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
        illegal.cast("long").alias("illegal"),
        F.col("plan.cost").alias("cost"),
        F.col("plan.audit").alias("audit"),
        repaired.alias("repaired"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """rows of conv_id, turn, role, text with damage by rule, and lost, true for
    a row that is gone: by the CRC32 of `conv_id:turn` modulo 20, 0 drops the
    row, 1 empties the text, 2 takes its . ! ? out, 3 repeats the row, 4 makes
    the role user. Nulls are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), (kind == 3).alias("twice"))
    return out.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")

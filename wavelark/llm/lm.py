"""LM scoring: a word model counted over the corpus, and causal attention.

One pass over the documents counts words and subwords of the training rows.
The attention model is trained on windows that tile every training text, so
that each subword is learnt from once. A window belongs to one of ROUNDS rounds
by a hash of its document's id and its place; in a round every task trains a
copy on its windows, and the copies' weights are averaged by Spark. Which
windows a task holds depends on the partitions, and with it a score's last
digits. A second pass scores every text. Counts of the HOT most
frequent words are broadcast; all other words meet their counts in a join.
"""

from __future__ import annotations

import base64
import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from .common import is_training, rows_of, scope, staged, utf8

#: Words whose counts are broadcast: some megabytes, whatever the corpus.
HOT = 131_072
#: Windows for one task of a round.
PER_TASK = 8192
ROUNDS, LEAST_STEPS = 3, 60
FLUSH = 400_000


@lru_cache(maxsize=2)
def subwords(path: str):
    """A byte-level encoder from a file of base64 tokens and ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words; blanks are space and \\t\\n\\v\\f\\r."""
    return (text or b"").lower().split()


class Classes:
    """Maps subword ids to output classes and inputs. Class 0 is the rest."""

    def __init__(self, counts: dict[int, int], size: int):
        self.end = size  # the id that ends a text
        n = np.zeros(size + 1, np.float64)
        for i, c in counts.items():
            n[i] = c
        head = np.lexsort((np.arange(size + 1), -n))[: A.HEAD - 1]
        head = head[n[head] > 0]
        self.classes = np.zeros(size + 1, np.int32)
        self.classes[head] = np.arange(1, len(head) + 1)
        inside = self.classes > 0
        self.inputs = np.where(inside, self.classes, A.HEAD + np.arange(size + 1) % A.BUCKETS).astype(np.int32)
        rest = n + 0.5
        self.tail = np.where(inside, 0.0, np.log(rest / rest[~inside].sum()))
        shares = np.bincount(self.classes, n + 1e-3 * ~inside, A.HEAD)
        self.shares = shares / max(shares.sum(), 1e-9)


def arrange(c: Classes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and target ids of a text's ids: it starts with START and ends
    with the end id."""
    targets = np.append(ids, c.end)
    return np.concatenate([[A.START], c.inputs[ids]]).astype(np.int32), targets


def score(w: A.Weights, c: Classes, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every text (arrays of ids). Of a later window
    only the places that it scores are computed; those before them give keys and
    values."""
    total = np.zeros(len(texts))
    xs, ys, starts, first, ends, owner = [], [], [], [], [], []
    at = 0
    for i, ids in enumerate(texts):
        x, y = arrange(c, ids)
        xs += [x, np.zeros(A.WINDOW, np.int32)]
        ys += [y, np.zeros(A.WINDOW, np.int64)]
        total[i] = c.tail[y].sum()
        for s, f in A.windows(len(y)):
            starts.append(at + s)
            first.append(f)
            ends.append(len(y) - s)
            owner.append(i)
        at += len(y) + A.WINDOW
    if not starts:
        return total
    x, y = np.concatenate(xs), c.classes[np.concatenate(ys)]
    start, begins, high, own = (np.array(v) for v in (starts, first, ends, owner))
    room = A.Room()
    for low in (0, A.WINDOW - A.STRIDE):
        steps = np.arange(low, A.WINDOW)
        some = np.flatnonzero(begins == low)
        for cut in np.split(some, range(A.BLOCK, len(some), A.BLOCK)):
            target = y[start[cut, None] + steps].ravel()
            order, bounds = A.sorted_by_group(target, (steps < high[cut, None]).ravel())
            z, _ = A.hidden(w, x[start[cut, None] + np.arange(A.WINDOW)], low, room)
            logp = A.log_probability(w, z.reshape(-1, A.WIDTH).take(order, axis=0), target[order], bounds, room)
            np.add.at(total, own[cut], np.bincount(order // len(steps), logp, len(cut)))
    return total


_GATHERED = "kind int, row long, id {kind}, text string, ids binary, word binary, n long"


def gather(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """One pass: 0 documents with their subword ids, 1 counts of training
    words, 2 counts of training subwords."""
    train = is_training(F.col(id_col), 5, 1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), train.alias("train"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path)
        seen: Counter[bytes] = Counter()
        pieces = np.zeros(coder.n_vocab + 1, np.int64)
        names = ["kind", "row", "id", "text", "ids", "word", "n"]
        id_type = None

        def rest(kind: int, words: list, n: list) -> pa.RecordBatch:
            size = len(n)
            none = lambda t: pa.nulls(size, t)
            return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), none(pa.int64()), none(id_type), none(pa.string()), none(pa.binary()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=names)

        for b in rows_of(batches, 512):
            id_type = b.column(1).type
            texts = b.column(2).to_pylist()
            coded = [np.array(coder.encode_ordinary(t), np.uint32) for t in texts]
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([0] * b.num_rows, pa.int32()), b.column(0), b.column(1), b.column(2).cast(pa.string()), pa.array([c.tobytes() for c in coded], pa.binary()), none, pa.nulls(b.num_rows, pa.int64())], names=names)
            for raw, ids, train in zip(utf8(b.column(2)), coded, b.column(3).to_pylist(), strict=True):
                if not train:
                    continue
                seen.update(words(raw))
                pieces += np.bincount(ids, minlength=len(pieces))
                pieces[-1] += 1
            if len(seen) > FLUSH:
                yield rest(1, list(seen), list(seen.values()))
                seen.clear()
        if id_type is not None:
            if seen:
                yield rest(1, list(seen), list(seen.values()))
            some = np.nonzero(pieces)[0]
            yield rest(2, [str(i).encode() for i in some.tolist()], pieces[some].tolist())

    return rows.mapInArrow(work, _GATHERED.format(kind=kind))


def windows(documents: DataFrame, r: int) -> DataFrame:
    """(ids): the windows of round r of documents (id, ids), as bytes: place and
    length of the text's ids (uint32), then the id before the window, if there is
    one, and the window's, first the lower halves of all (uint16) and, where a
    text has ids beyond them, the upper halves. The windows of all rounds hold
    every id and the end of every text once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = struct.Struct("=II").pack
        for b in rows_of(batches, 512):
            out = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                halves = np.frombuffer(raw, np.uint16)
                size, begun = len(raw) // 4, zlib.crc32(f"{name}:".encode())
                low, high = halves[::2].tobytes(), halves[1::2].tobytes() if halves[1::2].any() else b""
                for at in range(0, size + 1, A.WINDOW):
                    if zlib.crc32(b"%d" % at, begun) % ROUNDS == r:
                        cut = slice(2 * max(0, at - 1), 2 * (at + A.WINDOW))
                        out.append(pack(at, size) + low[cut] + high[cut])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return documents.select("id", "ids").mapInArrow(work, "ids binary")


def _examples(c: Classes, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows as inputs, target classes and scored positions."""
    numbers = np.frombuffer(b"".join(raw), np.uint16)
    held = np.array([len(x) // 2 for x in raw])
    begin = np.cumsum(held) - held
    at, size = (numbers[begin + i] + (numbers[begin + i + 1].astype(np.int64) << 16) for i in (0, 2))
    begin, before = begin + 4, (at > 0).astype(np.int64)
    upper = held - 4  # twice as many as ids, if upper halves are there
    held = np.minimum(size, at + A.WINDOW) - at + before
    upper = np.where(upper > held, held, 0)[:, None]
    ends = at + held - before == size
    n = np.minimum(A.WINDOW, held - before + ends)
    steps = np.arange(A.WINDOW)
    scored = steps < n[:, None]
    place = begin[:, None] + before[:, None] + steps  # of the targets
    last = (begin + held - 1)[:, None]  # of no ids: a half of the size, which is 0

    def of(table: np.ndarray, where: np.ndarray) -> np.ndarray:
        where = np.minimum(np.maximum(where, begin[:, None]), last)
        ids = numbers[where]
        return table[ids + np.where(upper > 0, numbers[where + upper].astype(np.int64) << 16, 0) if upper.any() else ids]

    y = np.where(steps < (held - before)[:, None], of(c.classes, place), c.classes[c.end])
    x = of(c.inputs, place - 1)
    x[at == 0, 0] = A.START
    return np.where(scored, x, 0).astype(np.int32), np.where(scored, y, 0).astype(np.int32), scored


def fit(documents: DataFrame, c: Classes, shares: np.ndarray) -> A.Weights:
    """Rounds of local training on all windows of documents (id, ids) and
    averaging."""
    w = A.initial(shares)
    told = F.sum(F.floor(F.octet_length("ids") / (4 * A.WINDOW)) + 1)
    tasks = max(1, ceil((documents.agg(told).first()[0] or 0) / ROUNDS / PER_TASK))
    spark = documents.sparkSession
    for r in range(ROUNDS):
        held = spark.sparkContext.broadcast((A.flatten(w), c))
        rate = 0.02 * 0.5**r

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, c = held.value
            raw = [x for b in batches for x in b.column(0).to_pylist()]  # about PER_TASK windows
            if not raw:
                return
            x, y, scored = _examples(c, raw)
            got = A.flatten(A.train(A.unflatten(flat), x, y, scored, max(LEAST_STEPS, ceil(len(x) / 128)), rate, seed=r))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(got.astype(np.float64)), pa.array(np.full(len(got), float(len(x))))], names=["i", "w", "n"])

        mean = windows(documents, r).repartition(tasks).mapInArrow(work, "i long, w double, n double").groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
        flat = np.array([x.w for x in mean.orderBy("i").collect()])  # one number per weight
        if len(flat):  # few texts may leave a round without windows
            w = A.unflatten(flat)
    return w


def frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words (word, c), HOT at most: those from a count on,
    so that no task sends more than its own share of them."""
    octave = F.floor(F.log2("c") * 4)
    sizes = {r["o"]: r["n"] for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect()}  # some hundred at most
    least, held = max(sizes, default=0) + 1, 0
    while (n := sizes.get(least - 1, 0)) + held <= HOT and least > 0:
        least, held = least - 1, held + n
    return counts.where(octave >= least)


def scores(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose id's crc32 as text is 1 modulo 5 are held out; the others are
    learnt from. A null text is as an empty one: its only token is the end. A
    row without an id is scored and never learnt from, its held_out is null.
    Repeated rows count as often as they occur. score is the log10
    probability that the attention model gives to the subwords and the end.
    """
    with scope() as own:
        scored, counts, total, floor = _scored(docs, tokenizer, id_col, text_col)
        own.keep(scored)
        own.keep(counts)
    rare = scored.where("word IS NOT NULL").select("row", "word", "n").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("sums"))
    out = scored.where("word IS NULL").join(rare, "row", "left")
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 1
    return out.select(
        F.col("id").alias(id_col),
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("sums", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score",
    )


def _scored(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, float]:
    """What scores joins: texts and their rarer words as one table, the counts of
    words, the training tokens and the log10 of what counts are divided by."""
    spark = docs.sparkSession
    got = staged(gather(docs, tokenizer, id_col, text_col), "gathered")
    counts = staged(got.where("kind = 1").groupBy("word").agg(F.sum("n").alias("c")), "words")
    told = counts.agg(F.sum("c"), F.count("*")).first()
    documents = got.where("kind = 0")
    training = documents.where(is_training(F.col("id"), 5, 1))
    trained = training.count()
    total = int(told[0] or 0) + trained
    distinct = int(told[1]) + (trained > 0)
    floor = math.log10(total + 0.5 * (distinct + 1))
    hot = {bytes(r.word): math.log10(r.c + 0.5) for r in frequent(counts).collect()}
    c = Classes({int(bytes(r.word)): r.n for r in got.where("kind = 2").groupBy("word").agg(F.sum("n").alias("n")).collect()}, subwords(tokenizer).n_vocab)
    w = fit(training, c, c.shares)
    held = spark.sparkContext.broadcast((A.flatten(w), c, hot))
    end = math.log10(trained + 0.5)
    kind = got.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, c, hot = held.value
        w = A.unflatten(flat)
        names = ["row", "id", "n_tokens", "known", "total", "score", "word", "n"]
        for b in rows_of(batches, 256):
            ids = [np.frombuffer(x, np.uint32).astype(np.int64) for x in b.column(3).to_pylist()]
            model = score(w, c, ids) / math.log(10)
            n_tokens, known, sums, rare_rows, rare, times = [], [], [], [], [], []
            for row, raw in zip(b.column(0).to_pylist(), utf8(b.column(2)), strict=True):
                all_words = words(raw)
                values = list(map(hot.get, all_words))
                missed = Counter(x for x, v in zip(all_words, values, strict=True) if v is None)
                some = [v for v in values if v is not None]
                n_tokens.append(len(all_words) + 1)
                known.append(len(some) + (trained > 0))
                sums.append(math.fsum(some) + end)
                rare_rows += repeat(row, len(missed))
                rare += missed
                times += missed.values()
            size, more = b.num_rows, len(rare)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(model), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64())], names=names)
            if more:
                none = lambda t: pa.nulls(more, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(rare_rows, pa.int64()), none(b.column(1).type), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=names)

    scored = documents.select("row", "id", "text", "ids").mapInArrow(work, f"row long, id {kind}, n_tokens long, known long, total double, score double, word binary, n long")
    return staged(scored, "scored"), counts, total, floor

"""The corpus queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, dialogue, lines, lm, neighbours, packing, quality, runs, sanitise, simhash, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The tokenizer file that packing uses."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, max_bits=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer(), 2048)


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitise(_table(spark, sf_dir, "documents")).drop("sanitised")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.membership(_table(spark, sf_dir, "documents"), scan=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)


def subword_tokenizer() -> str:
    """The subword file that LM scoring uses."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"), subword_tokenizer())


def dated_list(pages: DataFrame) -> DataFrame:
    """The list that op10 joins. The tables hold none, so it is made by rule
    from the hosts that occur: with h a number from the host's MD5, every
    third host is blocked from day h % 200 of 2024 on and off the list 60 days
    later, every fourth is allowed from day h % 300 on, and parent domains
    with h even are blocked from day 180 on."""
    number = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    hosts = pages.select(urlfilter.host(F.col("url")).alias("domain")).where("domain IS NOT NULL").distinct().withColumn("h", number(F.col("domain")))
    parents = hosts.select(F.regexp_replace("domain", r"^[^.]*\.", "").alias("domain")).distinct().withColumn("h", number(F.col("domain")))
    third, fourth = hosts.where("h % 3 = 0"), hosts.where("h % 4 = 1")
    return (
        third.select("domain", day(F.col("h") % 200).alias("day"), F.lit("block").alias("action"))
        .union(third.select("domain", day(F.col("h") % 200 + 60), F.lit("remove")))
        .union(fourth.select("domain", day(F.col("h") % 300), F.lit("allow")))
        .union(parents.where("h % 2 = 0").select("domain", day(F.lit(180)), F.lit("block")))
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch day; page_id gives one of 2024."""
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("day"))
    return urlfilter.verdicts(captures, dated_list(pages))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and the words of text, joined by spaces, which repeat in a tenth
    of the documents: with h the CRC32 of doc_id, g = floor(h / 10) and n words,
    where h % 10 = 0 each word i >= a becomes the one at a + (i - a) % p, with
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    rows = rows.select("doc_id", "text", "g", F.when(F.col("chosen"), words).alias("words"))
    n = F.size("words")
    rows = rows.select("*", F.when(n > 0, F.col("g") % n).alias("a"))
    rows = rows.select("*", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), a), tail), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periods(_table(spark, sf_dir, "documents")), least=12)
    best = runs.longest(F.col("runs"))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    length, period = -F.col("best.size"), F.col("best.period")
    hexed = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        hexed(runs.listed(F.col("runs"))).alias("runs_sha256"),
        hexed(F.col("collapsed")).alias("collapsed_sha256"),
    )


#: A conversation whose texts hold the template's own signs.
CONTROL = "\\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("turn"))
    own = own.select("conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    records = chat.conversations_as_records(rows).unionByName(chat.conversations_as_records(own))
    done = chat.formatted(chat.canonical(records), "turns")
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dialogue.repair(dialogue.damaged(_table(spark, sf_dir, "conversations")), lost_col="lost")
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return done.withColumn("repaired_sha256", F.sha2(text.cast("binary"), 256)).drop("repaired")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_warc": op2_warc,
        "op3_packing": op3_packing,
        "op4_sanitise": op4_sanitise,
        "op5_lines": op5_lines,
        "op6_quality": op6_quality,
        "op7_neighbours": op7_neighbours,
        "op8_decontamination": op8_decontamination,
        "op9_lm": op9_lm,
        "op10_urls": op10_urls,
        "op11_runs": op11_runs,
        "op12_chat": op12_chat,
        "op13_repair": op13_repair,
    }


_WARC_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


_URL_SQL = """
WITH captures AS (
    SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
        CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day
    FROM pages
), hosts AS (
    SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS INTEGER) AS h FROM (SELECT DISTINCT host AS domain FROM captures WHERE host IS NOT NULL)
), parents AS (
    SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS INTEGER) AS h FROM (SELECT DISTINCT regexp_replace(domain, '^[^.]*\\.', '') AS domain FROM hosts)
), entries AS (
    SELECT domain, DATE '2024-01-01' + CAST(h % 200 AS INTEGER) AS day, 2 AS rank FROM hosts WHERE h % 3 = 0
    UNION ALL SELECT domain, DATE '2024-01-01' + CAST(h % 200 + 60 AS INTEGER), 0 FROM hosts WHERE h % 3 = 0
    UNION ALL SELECT domain, DATE '2024-01-01' + CAST(h % 300 AS INTEGER), 1 FROM hosts WHERE h % 4 = 1
    UNION ALL SELECT domain, DATE '2024-01-01' + 180, 2 FROM parents WHERE h % 2 = 0
), dated AS (
    SELECT domain, CAST(day AS DATE) AS since, max(rank) AS rank FROM entries GROUP BY ALL
), spans AS (
    SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM dated
), above AS (
    SELECT page_id, day, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS domain
    FROM captures
), met AS (
    SELECT a.page_id, a.domain, s.since, s.rank, row_number() OVER (PARTITION BY a.page_id ORDER BY length(a.domain) DESC, a.domain DESC) AS place
    FROM above a JOIN spans s ON a.domain = s.domain AND a.day >= s.since AND (s.until IS NULL OR a.day < s.until) AND s.rank > 0
)
SELECT c.page_id, c.host, CASE m.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'unlisted' END AS verdict, m.domain, m.since
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND m.place = 1
"""


_CHAT_SQL = r"""
WITH given AS (
    SELECT 0 AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT 1, -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), written AS (
    SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
        ELSE 1 + length(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '#', '%23'), '<', '%3C')) END AS title,
        length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) AS body
    FROM given
), whole AS (
    SELECT own, conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
        CAST(sum(length('### ') + title + length(': ') + body + length('</turn>') + 1) AS BIGINT) AS formatted_chars
    FROM written GROUP BY own, conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM whole
"""

#: CRC32 bit by bit, edits from the end of each conversation with the least
#: audit of each state beside its cost, then applied to the rows.
_REPAIR_SQL = r"""
WITH RECURSIVE entries AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc
    FROM (SELECT unnest(range(256)) AS n)
), hashed AS (
    SELECT c.*, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations c, entries
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hashed)
), found AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS held, left(role, 1) AS initial
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged)
), faults AS (
    SELECT *, CASE WHEN held = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(held, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS illegal
    FROM found
), told AS (
    SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal,
        string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN initial IN ('s', 'u', 'a') THEN CASE WHEN fault = 'truncated' THEN upper(initial) ELSE initial END
            WHEN fault = 'truncated' THEN 'X' ELSE 'x' END, '' ORDER BY place) AS codes
    FROM faults GROUP BY conv_id
), steps AS (
    SELECT conv_id, codes, length(codes) AS t, {'c': CAST(0 AS BIGINT), 'a': ''} AS n, {'c': CAST(10 AS BIGINT), 'a': 'II'} AS s, {'c': CAST(5 AS BIGINT), 'a': 'I'} AS u, {'c': CAST(0 AS BIGINT), 'a': ''} AS a
    FROM told
    UNION ALL
    SELECT conv_id, codes, t,
        list_min([n, {'c': 5 + u.c, 'a': 'I' || u.a}, {'c': 10 + a.c, 'a': 'II' || a.a}]),
        list_min([s, {'c': 5 + u.c, 'a': 'I' || u.a}, {'c': 10 + a.c, 'a': 'II' || a.a}]),
        list_min([u, {'c': 5 + a.c, 'a': 'I' || a.a}]),
        list_min([a, {'c': 5 + u.c, 'a': 'I' || u.a}])
    FROM (
        SELECT conv_id, codes, t - 1 AS t,
            list_min([{'c': 2 + n.c, 'a': 'D' || n.a}, {'c': k + 1 + u.c, 'a': 'R' || u.a}, {'c': CASE x WHEN 'u' THEN k + u.c WHEN 's' THEN k + s.c ELSE 1000000000 END, 'a': CASE x WHEN 'u' THEN 'K' || u.a ELSE 'K' || s.a END}]) AS n,
            list_min([{'c': 2 + s.c, 'a': 'D' || s.a}, {'c': k + 1 + u.c, 'a': 'R' || u.a}, {'c': CASE x WHEN 'u' THEN k + u.c ELSE 1000000000 END, 'a': 'K' || u.a}]) AS s,
            list_min([{'c': 2 + u.c, 'a': 'D' || u.a}, {'c': k + 1 + a.c, 'a': 'R' || a.a}, {'c': CASE x WHEN 'a' THEN k + a.c ELSE 1000000000 END, 'a': 'K' || a.a}]) AS u,
            list_min([{'c': 2 + a.c, 'a': 'D' || a.a}, {'c': k + 1 + u.c, 'a': 'R' || u.a}, {'c': CASE x WHEN 'u' THEN k + u.c ELSE 1000000000 END, 'a': 'K' || u.a}]) AS a
        FROM (SELECT *, lower(substr(codes, t, 1)) AS x, CASE WHEN substr(codes, t, 1) = 'd' THEN 1000000000 WHEN substr(codes, t, 1) IN ('S', 'U', 'A', 'X') THEN 5 ELSE 0 END AS k FROM steps WHERE t > 0)
    )
), audits AS (
    SELECT conv_id, n.c AS cost, n.a AS audit FROM steps WHERE t = 0
), letters AS (
    SELECT conv_id, audit, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS i FROM audits WHERE audit <> ''
), placed AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER w AS place, count(*) FILTER (letter <> 'D') OVER w AS k, length(replace(audit, 'D', '')) AS m
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), repaired AS (
    SELECT p.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (k - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY i) AS text
    FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place
    WHERE letter <> 'D' GROUP BY p.conv_id
)
SELECT o.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _WARC_SQL, "op10_urls": _URL_SQL, "op12_chat": _CHAT_SQL, "op13_repair": _REPAIR_SQL}

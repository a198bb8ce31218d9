"""Packet semantics: validation, extensions, negotiation, reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W



#: Protocol versions in which features appear (fixed values).
FEATURE_SINCE = {"routing": 2, "fragments": 2, "capabilities": 3, "extensions": 3, "encryption": 3}
VERSIONS = (1, 2, 3)


def _found(*tests: tuple[Column, str, str]) -> Column:
    """(severity, code) of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for test, severity, code in tests]))


def validate(df: DataFrame, now_ns: int, most_payload: int) -> DataFrame:
    """PRO1: findings per packet, `packet.ok` where there are none."""
    found = _found(
        (F.col("timestamp_ns") > now_ns, "warning", "packet.timestamp_future"),
        (F.col("payload_size") > most_payload, "error", "packet.payload_too_large"),
        ((F.col("payload_size") == 0) & (F.col("kind") != "heartbeat"), "warning", "packet.empty_payload"),
        ((F.col("kind") == "control") & F.col("route").isNull(), "warning", "route.missing_control_route"),
        (F.size("route.relay_path") > 16, "warning", "route.long_relay_path"),
        (F.col("fragment.count") == 0, "error", "fragment.zero_count"),
        (F.col("fragment.sequence") >= F.col("fragment.count"), "error", "fragment.sequence_out_of_range"),
        (F.col("capabilities.max_payload") == 0, "warning", "capabilities.zero_payload"),
        (F.size("capabilities.sensor_bands") == 0, "note", "capabilities.no_bands"),
    )
    ok = F.array(F.struct(F.lit("note").alias("severity"), F.lit("packet.ok").alias("code")))
    rows = df.select("device", "offset", F.explode(F.when(F.size(found) > 0, found).otherwise(ok)).alias("f"))
    return rows.select("device", "offset", "f.severity", "f.code")


def validation_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("packets"))


def with_sections(df: DataFrame) -> DataFrame:
    """Test packets with optional sections by rule from their offset."""
    n = F.expr("(offset - 36) div 64")
    path = F.transform(F.sequence(F.lit(1), (n % 20 + 1).cast("int")), lambda i: i)
    return df.withColumns(
        {
            "route": F.when(n % 3 != 0, F.struct((n % 7).cast("int").alias("region"), (n % 256).cast("int").alias("priority"), path.alias("relay_path"))),
            "fragment": F.when(n % 11 == 0, F.struct((n % 5).cast("int").alias("sequence"), (n % 4).cast("int").alias("count"))),
            "capabilities": F.when(F.col("kind") == "capabilities", F.struct((n % 3 * 1024).cast("int").alias("max_payload"), F.when(n % 2 == 0, F.array(F.lit("vhf"))).otherwise(F.array().cast("array<string>")).alias("sensor_bands"))),
        }
    )


#: The built-in extension registry (fixed values): type, name, least and most
#: bytes, repeatable.
EXTENSIONS = ((1, "collector_id", 1, 8, False), (2, "site_name", 1, 128, False), (3, "capture_tags", 0, 4096, True), (4, "firmware_build", 1, 128, False), (5, "operator_note", 0, 512, True))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXTENSIONS, "type int, name string, least int, most int, repeatable boolean")


def extension_issues(extensions: DataFrame) -> DataFrame:
    """PRO2: one row per issue of extensions (packet, position, type, size)."""
    known = F.broadcast(registry(extensions.sparkSession))  # five rows
    rows = extensions.join(known, "type", "left").withColumn("n", F.count("*").over(W.partitionBy("packet", "type")))
    found = F.array_compact(
        F.array(
            F.when(F.col("name").isNull(), "unknown extension type"),
            F.when(F.col("size") < F.col("least"), "extension value is shorter than allowed"),
            F.when(F.col("size") > F.col("most"), "extension value is larger than allowed"),
            F.when(~F.col("repeatable") & (F.col("n") > 1), "extension type is not repeatable"),
        )
    )
    return rows.select("packet", "position", "type", F.explode(found).alias("issue"))


def validate_extensions(extensions: DataFrame, most: int = 64) -> DataFrame:
    """PRO1 on extensions (packet, position, type, size): (packet, severity, code,
    message): too many of a packet, and every issue of the registry."""
    many = extensions.groupBy("packet").agg(F.count("*").alias("n")).where(F.col("n") > most)
    many = many.select("packet", F.lit("error").alias("severity"), F.lit("extension.too_many").alias("code"), F.lit("packet has more extensions than allowed").alias("message"))
    return many.unionByName(extension_issues(extensions).select("packet", F.lit("warning").alias("severity"), F.lit("extension.invalid").alias("code"), F.col("issue").alias("message")))


def negotiate(peers: DataFrame, low: int = 1, high: int = 3, need_encryption: bool = False, prefer_compression: bool = True, least_payload: int = 256) -> DataFrame:
    """PRO3: what a local policy agrees with peers (device, max_payload,
    compression, encryption): the policy's highest version, the features that
    both sides have, and notes "decision: message", joined by "; ". Nulls count
    as 0 and false. A rejected peer gets no feature."""
    payload = F.coalesce("max_payload", F.lit(0))
    squeeze, secret = F.coalesce("compression", F.lit(False)), F.coalesce("encryption", F.lit(False))
    small = F.concat(F.lit("rejected_payload_limit: remote max payload "), payload.cast("string"), F.lit(f" is below required {least_payload}"))
    refused = F.when(F.lit(high < low), "rejected_version: invalid local version policy").when(payload < least_payload, small).when(F.lit(need_encryption) & ~secret, "disabled_encryption: remote does not support encryption")
    less = F.array_compact(F.array(F.when(F.lit(prefer_compression) & ~squeeze, "disabled_compression: compression disabled by remote capabilities"), F.when(~secret, "disabled_encryption: encryption disabled by remote capabilities")))
    notes = F.when(F.size(less) > 0, F.concat_ws("; ", less)).otherwise("accepted: negotiation accepted without downgrade")
    fine = refused.isNull()
    return peers.select("device", fine.alias("accepted"), F.lit(max(low, high)).alias("version"), (fine & F.lit(prefer_compression) & squeeze).alias("compression"), (fine & secret).alias("encryption"), F.coalesce(refused, notes).alias("notes"))


def version_matrix(spark: SparkSession) -> DataFrame:
    """PRO4: which feature a version has."""
    rows = [(v, f, v >= since) for v in VERSIONS for f, since in FEATURE_SINCE.items()]
    return spark.createDataFrame(rows, "version int, feature string, supported boolean")


def inspect(df: DataFrame) -> DataFrame:
    """PRO5: packet metadata as text; devices in sixteen hex digits."""
    return df.select(
        "offset",
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("device")), 16, "0")).alias("device_hex"),
        F.concat(F.col("kind"), F.lit("#"), F.col("sequence").cast("string")).alias("label"),
        F.concat(F.col("payload_size").cast("string"), F.lit(" bytes")).alias("payload"),
    )


def reassemble(fragments: DataFrame) -> DataFrame:
    """PRO6: whole payloads of (device, stream_id, sequence, count, arrival,
    payload): all pieces there, one count; the first copy of a piece counts,
    and the first arrival gives the metadata."""
    piece = fragments.groupBy("device", "stream_id", "sequence").agg(F.min_by("payload", "arrival").alias("payload"), F.min("arrival").alias("arrival"), F.min("count").alias("lo"), F.max("count").alias("hi"))
    whole = piece.groupBy("device", "stream_id").agg(F.count("*").alias("pieces"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("arrival").alias("first_arrival"), F.array_sort(F.collect_list(F.struct("sequence", "payload"))).alias("parts"))
    whole = whole.where((F.col("lo") == F.col("hi")) & (F.col("pieces") == F.col("lo")))
    return whole.select("device", "stream_id", F.col("pieces").alias("fragments"), "first_arrival", F.array_join(F.transform("parts", lambda p: p["payload"]), "").alias("payload"))


def payload_format(df: DataFrame) -> DataFrame:
    """COD8: the format of (kind, payload binary): the first byte if it is 1 to
    4, else by kind; heartbeats are unknown."""
    names = F.array(*[F.lit(x) for x in ("scalar", "spectrum", "control", "capability")])
    marker = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int")
    by_kind = F.when(F.col("kind") == "observation", "scalar").when(F.col("kind") == "spectrum", "spectrum").when(F.col("kind") == "control", "control").when(F.col("kind") == "capabilities", "capability").otherwise("unknown")
    return df.withColumn("format", F.when(marker.between(1, 4), F.get(names, marker - 1)).otherwise(by_kind))


def to_hex(data: Column, limit: int = 64) -> Column:
    """COD11: the first bytes in lower-case hex, with an ellipsis if there are more."""
    return F.concat(F.lower(F.hex(F.substring(data, 1, limit))), F.when(F.octet_length(data) > limit, F.lit("...")).otherwise(F.lit("")))


def priority(df: DataFrame, route_priority: Column) -> DataFrame:
    """RT1: ingest priority from the route, else from the kind."""
    p = F.when(route_priority >= 200, "critical").when(route_priority >= 128, "high").when(F.col("kind") == "control", "critical").when(F.col("kind").isin("heartbeat", "capabilities"), "high").otherwise("normal")
    return df.withColumn("priority", p)



"""python -m wavelark COMMAND PATH...: inspect, manifest, replay, salvage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, exports, query
from .sources import archives


def main(args: list[str]) -> int:
    """Exit code 3: the manifest has warnings."""
    p = argparse.ArgumentParser(prog="wavelark", description=__doc__)
    p.add_argument("command", choices=["inspect", "inspect-packet", "manifest", "replay", "salvage"])
    p.add_argument("paths", nargs="+")
    p.add_argument("--filter", default="", help="key=value tokens")
    p.add_argument("--from-ns", type=int, default=0)
    p.add_argument("--to-ns", type=int, default=0)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "salvage":
        print(exports.text_table(archives.salvage(spark, a.paths).select("archive_path", "offset", "capture_time_ns", "packet.ok", "packet.device")))
        return 0
    if a.command == "inspect-packet":
        print(exports.text_table(archives.read_frames(spark, a.paths).select("path", "packet.ok", "packet.error", "packet.kind", "packet.device", "packet.sequence")))
        return 0
    parsed = query.parse(a.filter)
    if parsed.problems:
        print("\n".join(parsed.problems), file=sys.stderr)
        return 2
    packets = archives.as_packets(archives.read(spark, a.paths))
    if a.command == "replay":
        print(exports.text_table(query.replay(packets, a.from_ns, a.to_ns)))
        return 0
    if a.command == "manifest":
        print(exports.text_table(aggregates.manifest_archives(packets)))
        return 3 if not aggregates.manifest_order_warnings(packets).isEmpty() else 0
    print(exports.text_table(query.archive(packets, parsed.query).select(*query.INDEX, F.col("kind"))))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

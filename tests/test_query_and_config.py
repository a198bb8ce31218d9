"""Filter strings, configs and small renderers."""

import pytest

from wavelark.operators import diagnostics, exports, query
from wavelark.sources import config


def test_filter_strings():
    p = query.parse("device=42 kind=spectrum min_payload=4 limit=2")
    assert not p.problems and p.query == query.Query(device=42, kind="spectrum", min_payload=4, limit=2)
    assert query.parse("kind = 4").query.kind == "control"
    assert query.describe(p.query) == "device=42 kind=3 min_payload=4 limit=2"
    for text in ("device=", "=3", "kind=6", "start=x", "what=1", "start=5 end=4", "min_payload=3 max_payload=2", 'kind="x'):
        assert query.parse(text).problems, text


def test_config():
    c = config.parse('# a\ncollector.name = "east \\"primary\\"" # c\ncollector.region = 12 # x\narchive.enabled=yes\ncollector.region = 13\n')
    assert c.text("collector.name") == 'east "primary"' and c.integer("collector.region") == 13 and c.flag("archive.enabled")
    assert config.profile(c).warnings == ("archive never rotates",)
    bad = config.parse("collector.region = 70000\narchive.enabled = maybe\ncollector.name = x")
    assert len(config.validate(bad)) == 2
    assert not bad.flag("archive.enabled", True) and bad.integer("nothing", 4) == 4
    for text in ("novalue", 'a = "x', 'a = "\\q"', "a\0 = 1", "a b = 1"):
        with pytest.raises(config.ConfigError):
            config.parse(text)


def test_labels():
    assert diagnostics.duration_label(3_600_000_000_000) == "1h" and diagnostics.duration_label(0) == "all"


def test_text_table(spark):
    t = exports.text_table(spark.createDataFrame([(1, "ab"), (22, None)], "n int, s string"))
    assert t.splitlines() == ["n   s", "--  --", "1   ab", "22"]


def test_empty_inputs(spark, data):
    from wavelark.operators import aggregates, sequences
    from wavelark.sources import adapters

    none = adapters.packets(spark, data).where("false")
    assert aggregates.density(none).first().records_per_archive == 0.0
    assert sequences.anomalies(none).count() == 0 and query.stats(none, query.Query()).first().scanned == 0

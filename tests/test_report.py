"""The statistics report reads its packets once."""

from wavelark.operators import report
from wavelark.sources import adapters

DAY = 86_400_000_000_000


def test_one_scan(spark, data):
    packets = adapters.packets(spark, data)
    plan = report.partials(packets, DAY, DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    whole = report.statistics(packets, DAY, DAY)._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id" not in whole


def test_empty(spark, data):
    got = report.statistics(adapters.packets(spark, data).where("false"), DAY, DAY, overlaps=True).collect()
    assert [(r.part, r.records, r.payload_bytes, r.archives, r.average) for r in got] == [("summary", 0, 0, 0, 0.0)]

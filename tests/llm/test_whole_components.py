"""Components aren't cut off after a number of steps."""

from __future__ import annotations

from docketlake.llm import components


def test_no_cap_on_steps(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_STEPS", 1, raising=False)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components.connected_components(path).collect()} == {(i, 0) for i in range(41)}

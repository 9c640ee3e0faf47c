from __future__ import annotations

import json

from tracemill.operators import steps as S
from tracemill.sources.traces import read_traces
from tracemill.streaming import live

from .conftest import BASIC


def test_running_totals(spark, trace_file, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate((BASIC[:4], BASIC[4:])):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({**e, "trace_id": "basic", "ord": i}) for i, e in enumerate(part)))
    steps = S.steps(read_traces(spark, trace_file))
    stream = live.running_facts(live.event_stream(spark, str(folder), 1), steps)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("facts").start()
    query.processAllAvailable()
    query.stop()
    assert {r["name"]: r["dur_ms"] for r in spark.table("facts").collect() if r["kind"] == "kernel"} == {"triton_poi_fused_add_3": 9.0, "sm80_xmma_gemm_f16": 6.0, "triton_red_fused_sum_1": 3.0}

from __future__ import annotations

import json

import pytest
from pyspark.sql import SparkSession

def _step(number, ts):
    return {"name": f"ProfilerStep#{number}", "cat": "user_annotation", "ts": ts, "dur": 40000}


#: A small trace: three steps of 40 ms, not in order in the file, kernels in two of them, one communication annotation.
BASIC = [
    {"name": "sm80_xmma_gemm_f16", "cat": "kernel", "ts": 5002500, "dur": 6000, "args": {}},
    _step(8, 5040000),
    _step(7, 5000000),
    {"name": "triton_poi_fused_add_3", "cat": "kernel", "ts": 5000100, "dur": 9000, "args": {"kernel num(GB)": "2.25", "IO efficiency(GB/s)": 512.5, "kernel kwargs": "XBLOCK=64,\nnum_warps=4\r", "triton output code": "code, \"y\"", "other": {"a": [1]}}},
    {"name": "ncclAllGather_ring", "cat": "gpu_user_annotation", "ts": 5013000, "dur": 1500, "args": {"Collective name": "allgather"}},
    {"name": "aten::mul", "cat": "cpu_op", "ts": 5012000, "dur": 600, "args": {}},
    {"name": "triton_red_fused_sum_1", "cat": "kernel", "ts": 5081000, "dur": 3000, "args": {}},
    _step(9, 5080000),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def trace_file(tmp_path):
    path = tmp_path / "basic.json"
    path.write_text(json.dumps({"traceEvents": BASIC, "schemaVersion": 1}))
    return str(path)

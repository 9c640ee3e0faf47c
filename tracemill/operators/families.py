"""Kernel families from names, as column expressions: classify distinct names, not events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COLLECTIVE as COLLECTIVE_KEY

# Families by the first keyword found in the lower-cased name, in this order.
KEYWORDS = (
    ("gemm", ("gemm", "sgemm", "dgemm", "hgemm", "igemm", "bgemm", "cutlass", "matmul", "cublas")),
    ("attention", ("flash_attn", "flash_attention", "fmha", "scaled_dot_product", "self_attention")),
    ("norm", ("layer_norm", "layernorm", "rms_norm", "rmsnorm", "group_norm", "groupnorm", "batch_norm", "batchnorm")),
    ("elementwise", ("elementwise", "pointwise", "eltwise")),
    ("embedding", ("embedding", "lookup_table")),
    ("conv", ("conv2d", "conv1d", "conv3d", "convolution", "scudnn", "cudnn_conv", "winograd")),
    ("softmax", ("softmax", "log_softmax")),
    ("reduce", ("reduce_", "cub::device_reduce", "sum_kernel", "mean_kernel")),
    ("dropout", ("dropout",)),
    ("index_op", ("index_", "scatter", "gather_", "take_")),
    ("sort", ("sort_", "topk", "argsort")),
    ("memory", ("copy_", "memcpy", "fill_", "zeros_", "ones_")),
)
# What makes a kernel a collective, kinds of Triton kernels, and scopes before a function's name.
COLLECTIVE_WORDS = ("nccl", "cncl", "collective", "allreduce", "allgather", "reducescatter", "broadcast_")
COLLECTIVE_PREFIX = "tcdp"
TRITON_KINDS = {"red": "triton_reduce", "per": "triton_reduce", "poi": "triton_pointwise", "tem": "triton_pointwise", "mm": "triton_mm"}
SCOPES = r"^(void\s+|at::native::|\w+::)+"
COLLECTIVE, OTHER = "collective", "other"


def keyword_group(low: Column) -> Column:
    """The first group of which a keyword is in a lower-cased name, collectives before all others; null if none.

    One lookup in a constant array: as a chain of conditions this outgrows what Spark can compile where it is used twice.
    """
    groups = F.array(*(F.struct(F.lit(g).alias("g"), F.array(*map(F.lit, words)).alias("words")) for g, words in ((COLLECTIVE, COLLECTIVE_WORDS), *KEYWORDS)))
    return F.get(F.filter(groups, lambda x: F.exists(x["words"], lambda w: F.contains(low, w))), F.lit(0))["g"]


def family(name: Column) -> Column:
    """A kernel's family: Triton kinds, then collectives, then keywords in order, then the bare function name, case kept."""
    low = F.lower(name)
    token = F.element_at(F.split(low, "_"), 2)
    kinds = F.create_map(*(F.lit(x) for kv in TRITON_KINDS.items() for x in kv))
    bare = F.regexp_extract(F.regexp_replace(name, f"(?iU){SCOPES}", ""), r"^[^<(]*", 0)
    bare = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")
    return (
        F.when(low.startswith("triton_"), F.coalesce(kinds[token], F.concat(F.lit("triton_"), token)))
        .when(low.startswith(COLLECTIVE_PREFIX), COLLECTIVE)
        .otherwise(F.coalesce(keyword_group(low), F.nullif(bare, F.lit("")), F.lit(OTHER)))
    )


def is_collective_by_args(args: Column) -> Column:
    return F.coalesce(args.getField(COLLECTIVE_KEY), F.lit("")) != ""


def kernel_type(name: Column, by_args: Column, patterns: Sequence[str] = ()) -> Column:
    """One type a kernel: triton (case counts), else the first pattern that its lower-cased name contains, else collective if ``by_args``, else its family. Patterns are taken as written, so one with capitals never matches."""
    out = F.when(name.startswith("triton_"), "triton")
    for p in patterns:
        out = out.when(F.lower(name).contains(p), p)
    return out.when(by_args, COLLECTIVE).otherwise(family(name))


def pattern_types(name: Column, by_args: Column, patterns: Sequence[str]) -> Column:
    """An array of all types of a kernel: its one type and, for a Triton kernel, every pattern that its lower-cased name contains."""
    own = F.array(kernel_type(name, by_args, patterns))
    if not patterns:
        return own
    also = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.lower(name).contains(p))
    return F.when(name.startswith("triton_"), F.concat(own, also)).otherwise(own)

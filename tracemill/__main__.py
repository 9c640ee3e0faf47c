"""python -m tracemill TRACE [TRACE]: reports and result tables of one trace, or of two side by side."""

from __future__ import annotations

import argparse
from uuid import uuid4

from .analysis import analyse, comparison_report, single_report, write_comparison, write_single
from .session import session
from .sources.traces import read_traces, trace_files, trace_ids
from .store import file_system

# The defaults that users of these options know.
FOLDER, TOP, TYPES = ".", 10, "gemm,embedding,pool"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    parser.add_argument("traces", nargs="+", help="one or two trace files")
    parser.add_argument("-o", "--output-dir", default=FOLDER, help="where files go (default: here)")
    parser.add_argument("-n", "--top-n", type=int, default=TOP, help=f"how many kernels are ranked (default: {TOP})")
    parser.add_argument("-s", "--save-triton-csv", action="store_true", help="also a table of each step's Triton calls")
    parser.add_argument("-c", "--save-triton-code", action="store_true", help="also the code of each call")
    parser.add_argument("-k", "--kernel-types", default=TYPES, help=f"comma-separated patterns for type facts (default: {TYPES})")
    args = parser.parse_args(argv)
    if len(args.traces) > 2:
        parser.error("one or two traces")
    spark = session()
    files = [trace_files(spark, t) for t in args.traces]
    if any(len(f) != 1 for f in files):
        parser.error("each trace is one file")
    events = read_traces(spark, *args.traces)
    facts = f"{args.output_dir}/.facts-{uuid4().hex}"
    try:
        found = analyse(events, [p for p in args.kernel_types.split(",") if p]).stored(facts)
        if len(files) == 1:
            print(single_report(found, args.top_n))
            write_single(found, args.output_dir, args.save_triton_csv, args.save_triton_code)
        else:
            paths = [own[0] for own in files]
            ids = trace_ids(paths)
            names = [p.rpartition("/")[2] for p in paths]
            a, b = (ids[p] for p in paths)
            # files are called by their names, or where these are the same by what tells them apart
            print(comparison_report(found, a, b, args.top_n, names if names[0] != names[1] else None))
            write_comparison(found, a, b, args.output_dir)
    finally:
        fs, at = file_system(spark, facts)
        fs.delete(at, True)


if __name__ == "__main__":
    main()

"""python -m skriva METRIC REFERENCE HYPOTHESIS: print the scores of two files as JSON.

Exit codes: 0 scored, 1 a file cannot be read, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from skriva.plans.scorers import METRICS, SCORERS


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skriva", description="Scores of a hypothesis file against a reference.")
    p.add_argument("metric", choices=METRICS)
    p.add_argument("reference")
    p.add_argument("hypothesis")
    a = p.parse_args(argv)
    if a.metric == "timing" and not all(x.lower().endswith((".srt", ".vtt")) for x in (a.reference, a.hypothesis)):
        p.error("timing needs two subtitle files (.srt or .vtt)")
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("skriva").getOrCreate()
    try:
        for line in SCORERS[a.metric](spark, a.reference, a.hypothesis).toJSON().collect():
            print(line)
    except AnalysisException as e:
        print(f"skriva: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

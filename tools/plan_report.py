"""Summarise the physical plan of every registered query (markdown table).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts come from ``explain("formatted")`` before AQE re-planning.
"""

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.queries import load_all  # noqa: E402
from tessera.session import get_session  # noqa: E402


def summarize(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    bx = tree.count("BroadcastExchange")
    return {
        "shuffles": tree.count("Exchange") - bx - tree.count("ReusedExchange"),
        "broadcasts": bx,
        "scans": tree.count("Scan parquet"),
        "smj": tree.count("SortMergeJoin"),
        "bhj": tree.count("BroadcastHashJoin"),
        "window": tree.count("Window ") + tree.count("Window\n"),
        "group_limit": tree.count("WindowGroupLimit"),
        "generate": tree.count("Generate"),
        "cartesian": tree.count("CartesianProduct") + tree.count("BroadcastNestedLoopJoin"),
        "python": tree.count("EvalPython") + tree.count("FlatMapGroupsInPandas"),
        "pushed": text.count("PushedFilters: [") - text.count("PushedFilters: []"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 16)
    q, _ = load_all()
    cols = ["shuffles", "broadcasts", "scans", "smj", "bhj", "window", "group_limit", "generate", "cartesian",
            "python", "pushed"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---" * (len(cols) + 1) + "|")
    for name, fn in q.items():
        s = summarize(fn(spark, sf))
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()

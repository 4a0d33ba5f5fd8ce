"""``python -m citeloom.cli``: reports from files or tables.

Exit codes: 0 done, 1 the --fail-on condition holds, 2 bad input.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from citeloom.operators import resolve
from citeloom.plans import audit, parse_report


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="citeloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("parse", help="report on a .bib file and, optionally, a .tex file, without look-ups")
    a.add_argument("bib")
    a.add_argument("tex", nargs="?")
    a.add_argument("--format", choices=["text", "json"], default="text")
    b = sub.add_parser("audit", help="audit the tables of a folder")
    b.add_argument("tables")
    b.add_argument("--format", choices=["text", "json"], default="text")
    b.add_argument("--out", help="folder for the report table; printed if absent")
    b.add_argument("--fail-on", choices=["hallucinated", "multiple"])
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("citeloom").getOrCreate()
    if args.command == "parse":
        try:
            report = parse_report.parse_report(spark, args.bib, args.tex)
        except (ValueError, OSError) as e:
            print(e, file=sys.stderr)
            return 2
        if args.format == "text":
            print(parse_report.text_report(report))
        else:
            print("\n".join(r.json for r in resolve.report_json(report["entries"].drop("bib_file")).collect()))
        return 0
    rows = audit.report(spark, args.tables).cache()
    lines = resolve.report_lines(rows) if args.format == "text" else resolve.report_json(rows)
    if args.out:
        lines.write.mode("overwrite").json(args.out)
    else:
        for r in lines.orderBy(*lines.columns).toLocalIterator():
            print(*r)
    return resolve.gate(rows, args.fail_on) if args.fail_on else 0


if __name__ == "__main__":
    sys.exit(main())

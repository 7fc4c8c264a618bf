"""python -m driftlens analyse --pairs DIR [--headers DIR] [--report FILE] [--summary DIR] [--template FILE --page FILE]

Exit status: 0 done, 1 failed, 2 not understood.
"""

from __future__ import annotations

import argparse
import gzip
import sys
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="driftlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    analyse = commands.add_parser("analyse", help="figures of a study from its artefacts")
    analyse.add_argument("--pairs", required=True)
    analyse.add_argument("--headers")
    analyse.add_argument("--report", help="compressed if its name ends with .gz")
    analyse.add_argument("--summary", help="folder for the figures as an artefact")
    analyse.add_argument("--template")
    analyse.add_argument("--page")
    update = commands.add_parser("update", help="adds artefacts that are new to the counts")
    for name in ("--pairs", "--out", "--checkpoint"):
        update.add_argument(name, required=True)
    given = parser.parse_args(args)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("driftlens").getOrCreate()
    try:
        if given.command == "update":
            from driftlens.streaming import incremental

            print(f"{incremental.update_counts(spark, given.pairs, given.out, given.checkpoint)} batches")
            return 0
        from driftlens.plans import rendering, study
        from driftlens.sources import artifacts

        summary = study.analyse(study.from_artifacts(spark, given.pairs, given.headers))
        text = rendering.text_report(summary)
        print(text, end="")
        if given.report:
            data = text.encode()
            Path(given.report).write_bytes(gzip.compress(data, mtime=0) if given.report.endswith(".gz") else data)
        if given.summary:
            artifacts.write_artifact(study.summary_row(summary), given.summary, "summary")
        if given.template and given.page:
            Path(given.page).write_text(rendering.page(summary, Path(given.template).read_text()))
        return 0
    except Exception as e:  # the message is for a person at a terminal
        print(f"driftlens: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

"""Command line: ``score``, ``calibrate`` and ``compare``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from polescale.config import AXES, GAMMA, LABELS, POLES, WORD_CI_DRAWS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="polescale")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("score")
    s.add_argument("text", nargs="?")
    s.add_argument("--file")
    s.add_argument("--gamma", type=float, default=GAMMA)
    s.add_argument("--no-stance", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--stand-in", action="store_true", help="deterministic stand-ins instead of pretrained models")
    for name in ("calibrate", "compare"):
        c = sub.add_parser(name)
        c.add_argument("--root", default=os.environ.get("POLESCALE_ROOT", "/data/corpus"))
        c.add_argument("--axis", required=True)
        c.add_argument("--dry-run", action="store_true")
        if name == "calibrate":
            c.add_argument("--bootstrap-n", type=int, default=WORD_CI_DRAWS)
            c.add_argument("--min-docs-per-pole", type=int, default=5)
        else:
            for option in ("--lexicon", "--tests-dir", "--oracle", "--predictions-dir"):
                c.add_argument(option)
            c.add_argument("--scoring", default="lbg")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "score":
        text = Path(a.file).read_text(encoding="utf-8") if a.file else a.text if a.text is not None else sys.stdin.read()
        if not text.strip():
            print("no text", file=sys.stderr)
            return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("polescale").getOrCreate()
    if a.command == "score":
        from polescale.plans import models, providers
        from polescale.plans.score import score_payload
        from polescale.sources.corpus import direct

        wanted = ["embedder"] if a.no_stance else ["embedder", "entailment"]
        missing = [models.PACKAGES[k] for k in wanted if not models.installed(k)]
        if missing and not a.stand_in:
            print(f"not installed: {', '.join(missing)}; scores below come from stand-ins and mean nothing", file=sys.stderr)
        if missing or a.stand_in:
            embedder, entailment, name = providers.hashed_embedder(), providers.overlap_entailment(), "stand-in"
        else:
            embedder, entailment, name = models.embedder(), models.entailment(), models.ENTAILMENT
        row = score_payload(spark, direct(spark, text), embedder, None if a.no_stance else entailment, gamma=a.gamma, use_stance=not a.no_stance, model=name).first()
        if a.json:
            print(json.dumps(row.asDict(True), ensure_ascii=False))
        else:
            for pole in POLES:
                print(f"{LABELS[pole]:10s} {row['scores'][pole]:.4f}" + (" ←" if pole == row["dominant_pole"] else ""))
        return 0
    if a.axis not in AXES:
        print(f"unknown axis {a.axis}", file=sys.stderr)
        return 1
    if a.command == "calibrate":
        from polescale.plans.calibrate import calibrate

        return calibrate(spark, a.root, a.axis, a.dry_run, a.min_docs_per_pole, a.bootstrap_n)
    from polescale.plans.compare import compare

    return compare(spark, a.root, a.axis, a.dry_run, a.lexicon, a.tests_dir, a.oracle, a.predictions_dir, a.scoring)


if __name__ == "__main__":
    sys.exit(main())

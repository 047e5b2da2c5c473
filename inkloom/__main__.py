"""python -m inkloom ROOT COMMAND ...: the archive's commands on the session that spark-submit or the environment gives."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from inkloom.archive import Archive
from inkloom.operators import images, scoring, transcribe


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkloom", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    chosen = argparse.ArgumentParser(add_help=False)
    chosen.add_argument("--page", "-p", action="append")
    chosen.add_argument("--letter")
    c = sub.add_parser("ingest")
    c.add_argument("directory")
    c.add_argument("--letter")
    c = sub.add_parser("preprocess", parents=[chosen])
    c.add_argument("--bands", type=int, default=5)
    c.add_argument("--long-side", type=int, default=2200)
    c.add_argument("--no-dewarp", action="store_true")
    c.add_argument("--bleed", type=float, default=0.6)
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("transcribe", parents=[chosen])
    c.add_argument("--engine", default="echo")
    c.add_argument("--prompt", required=True)
    c.add_argument("--samples", type=int, default=1)
    c.add_argument("--temperature", type=float, default=0.6)
    c.add_argument("--with-bands", action="store_true")
    c.add_argument("--few-shot", type=int, default=2)
    c = sub.add_parser("reconcile", parents=[chosen])
    c.add_argument("--prefer", default="local")
    c.add_argument("--correct-with")
    c = sub.add_parser("evaluate")
    c.add_argument("--detail", action="store_true")
    c = sub.add_parser("gold")
    c.add_argument("--promote", action="store_true")
    c.add_argument("--seed", action="store_true")
    c = sub.add_parser("enrich")
    c.add_argument("--engine", default="echo")
    c.add_argument("--letter", "-l", action="append")
    c = sub.add_parser("export")
    c.add_argument("out")
    c.add_argument("--no-images", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> str:
    """Carries out one command and gives what it reports."""
    a = parser().parse_args(argv)
    x = Archive(spark, a.root)
    if a.command == "ingest":
        return f"{x.ingest(a.directory, a.letter)} pages registered"
    if a.command == "preprocess":
        config = images.Config(long_side=a.long_side, dewarp=not a.no_dewarp, bands=a.bands, bleed_strength=a.bleed)
        return f"{x.preprocess(a.page, a.letter, config, a.force)} pages processed"
    if a.command == "transcribe":
        return f"{x.transcribe(a.engine, a.prompt, a.page, a.letter, a.samples, a.temperature, with_bands=a.with_bands, shots=a.few_shot)} lines written"
    if a.command == "reconcile":
        return f"{x.reconcile(a.page, a.letter, a.prefer, transcribe.engine(a.correct_with) if a.correct_with else None)} pages reconciled"
    if a.command == "evaluate":
        board, detail = x.evaluate()
        rows = [board.columns, *map(list, scoring.rendered(board).collect())]  # a row for each system
        if a.detail:
            detail.show()
        return "\n".join("  ".join(r) for r in rows) if len(rows) > 1 else "nothing to evaluate yet"
    if a.command == "gold":
        said = [f"{x.seed_gold()} checked texts put into letters"] if a.seed else []
        said += [f"{x.promote_gold()} reviewed pages written"] if a.promote else []
        return "\n".join([*said, "{} checked texts match {} pages".format(*x.coverage())])
    if a.command == "enrich":
        return str(x.enrich(transcribe.engine(a.engine), a.letter))
    return str(x.export(a.out, not a.no_images))


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("inkloom").getOrCreate()))

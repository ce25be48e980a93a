"""Command lines for looking at models, predictions and pictures: python -m foliant <command> --help."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import ocr
from foliant.operators import evaluation
from foliant.plans.graph import bind
from foliant.plans.shipping import ship
from foliant.sources import files, models

PREDICTIONS = "file string, elapsed_ms double, lines array<struct<text:string,rec:double,det:double,cls:int,cls_score:double,rotate:boolean,box:array<double>>>"


def _spark() -> SparkSession:
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    return spark


def _found(predictions: DataFrame) -> DataFrame:
    """Lines of predictions as evaluation takes them."""
    each = predictions.select("file", F.posexplode("lines").alias("pred", "l"))
    x0, y0, x1, y1 = evaluation.box_bounds(F.col("l.box"))
    return each.select("file", "pred", x0.alias("p_x0"), y0.alias("p_y0"), x1.alias("p_x1"), y1.alias("p_y1"), F.col("l.text").alias("actual"))


def evaluate(a: argparse.Namespace) -> int:
    spark = _spark()
    truth = files.ground_truth(spark, a.truth).select("file", "gt", *[F.col("bbox")[k].alias(f"g_{c}") for k, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("text").alias("expected"))
    predictions = files.predictions(spark, a.predictions, PREDICTIONS)
    known = evaluation.required(truth.select("file").distinct(), predictions.select("file", F.coalesce("elapsed_ms", F.lit(0.0)).alias("elapsed_ms")))
    report = evaluation.report(truth, _found(predictions.join(known.select("file"), "file", "left_semi")), known, a.iou)
    if a.output:
        files.write_report(report, a.output, "Evaluation")
    print(json.dumps(report.where("file IS NULL").drop("file").head().asDict()))
    return 0


def diff(a: argparse.Namespace) -> int:
    spark = _spark()
    left, right = (files.predictions(spark, p, PREDICTIONS).select("file", "lines") for p in (a.baseline, a.candidate))
    row = evaluation.difference(left, right, a.tolerance).head().asDict()
    print(json.dumps(row))
    return 0 if row["agrees"] else 1


def model(a: argparse.Namespace) -> int:
    """Nodes that run for an input shape, and what they need alive at once."""
    plan = bind(models.read(Path(a.path).read_bytes()), tuple(a.shape))
    for n in plan.nodes:
        print(n.op, *n.inputs, "->", n.output, list(plan.shapes.get(n.output, ())))
    spans = plan.lifetimes()
    alive = [sum(size for _, birth, death, size in spans if birth <= t <= death) for t in range(len(plan.nodes))]
    print(json.dumps({"nodes": len(plan.nodes), "weights": int(sum(c.size for c in plan.constants.values())), "live_bytes": max(alive, default=0)}))
    return 0


def container(a: argparse.Namespace) -> int:
    Path(a.output).write_bytes(models.write_container(models.read(Path(a.path).read_bytes())))
    return 0


def recognise(a: argparse.Namespace) -> int:
    spark = _spark()
    engine = ocr.Ocr.load(spark, a.detector, a.recogniser, a.labels, a.classifier, ocr.Options(order=a.order))
    files.write_predictions(ocr.prediction_records(engine.recognise(files.pictures(spark, a.pictures))), a.output, digits=9)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="foliant", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(f, *positional: str, **options):
        p = commands.add_parser(f.__name__, help=f.__doc__)
        for name in positional:
            p.add_argument(name)
        for name, how in options.items():
            p.add_argument(f"--{name}", **how)
        p.set_defaults(run=f)

    command(evaluate, "truth", "predictions", iou={"type": float, "default": 0.3}, output={})
    command(diff, "baseline", "candidate", tolerance={"type": float, "default": 0.0})
    command(model, "path", shape={"type": int, "nargs": 4, "default": [1, 3, 640, 640]})
    command(container, "path", "output")
    command(recognise, "pictures", "output", detector={"required": True}, recogniser={"required": True}, labels={"required": True}, classifier={}, order={"choices": ocr.ORDERS, "default": "horizontal"})
    args = top.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())

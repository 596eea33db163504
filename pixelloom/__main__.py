"""python -m pixelloom VERB ...: features of images, their combinations, training, and inference, from and to Parquet."""

from __future__ import annotations

import argparse
import json
import sys

from . import get_session
from .operators import extractor, features, ml
from .operators.registry import enabled
from .sources import images, tables


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pixelloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("extract", help="features of every image below a folder")
    one.add_argument("images")
    one.add_argument("out")
    one.add_argument("--families", default="surface", help="comma-separated: " + ",".join(features.FAMILIES))
    one.add_argument("--label", type=int, choices=(0, 1))
    one = verbs.add_parser("combine", help="features of all modules, and how many each pair has")
    one.add_argument("images")
    one.add_argument("out")
    one.add_argument("--modules", help="comma-separated; all if left out")
    one = verbs.add_parser("train", help="a model of a table of features, label and img_id")
    one.add_argument("table")
    one.add_argument("model")
    one.add_argument("--options", help="a TOML file")
    one.add_argument("--rounds", type=int)
    one = verbs.add_parser("infer", help="probability and origin of every row of a table of features")
    one.add_argument("table")
    one.add_argument("model")
    one.add_argument("out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_session()
    if args.verb == "extract":
        rows = images.read_images(spark, args.images, args.label)
        found = features.extract(rows, args.families.split(","))
        keep = [c for c in ("path", "label") if c in rows.columns]
        rows.select("img_id", *keep).join(found, "img_id").write.mode("overwrite").parquet(args.out)
    elif args.verb == "combine":
        out = extractor.run_combinations(images.read_images(spark, args.images), args.out, enabled(args.modules.split(",") if args.modules else None))
        print(json.dumps(out["summary"], sort_keys=True))
    elif args.verb == "train":
        table = spark.read.parquet(args.table)
        numbers = [c for c, t in table.dtypes if t == "double"]
        model = ml.train(table, numbers, tables.load_options(args.options), rounds=args.rounds)
        model.save(args.model)
        print(json.dumps(model.metrics, sort_keys=True))
    else:
        ml.load(args.model).score(spark.read.parquet(args.table)).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: score, train, aggregate, publish, list datasets, ping."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evalgrid")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ping")
    p = commands.add_parser("score")
    p.add_argument("--prediction-path", required=True)
    p.add_argument("--metric-path", required=True)
    p.add_argument("--dataset-path", required=True)
    p.add_argument("--selected-metrics", nargs="*")
    p.add_argument("--model-name")
    p.add_argument("--split")
    p.add_argument("--target")
    p.add_argument("--fold", type=int)
    p.add_argument("--score-modes", nargs="*")
    p.add_argument("--variables", nargs="*", default=[], help="keys beside the sequence; else those that the dataset declares")
    p = commands.add_parser("train")
    p.add_argument("--dataset-file", required=True)
    p.add_argument("--output-path", required=True)
    p.add_argument("--model", required=True, choices=["pls", "ridge"])
    p.add_argument("--split", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--test-fold", type=int, required=True)
    p.add_argument("--model-card-file", help="its hyper_parameters are the model's settings")
    p = commands.add_parser("datasets-list")
    p.add_argument("--catalog", required=True, help="CSV of name, input_filename, splits, targets and kinds, lists separated by blanks")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--manifest-dir", help="folder with <name>/manifest.lock")
    p = commands.add_parser("aggregate")
    p.add_argument("--fold-documents", required=True, help="a glob of score documents")
    p.add_argument("--output-path", required=True)
    p = commands.add_parser("generate-csv")
    p.add_argument("--metric-dir", required=True)
    p.add_argument("--output-path", required=True)
    p.add_argument("--game", required=True)
    args = parser.parse_args(argv)
    if args.command == "ping":
        print("pong")
        return 0
    from pyspark.sql import SparkSession

    from evalgrid.plans.evaluate import aggregate_run, card_settings, datasets_list, evaluate, publish, train

    spark = SparkSession.builder.appName("evalgrid").getOrCreate()
    if args.command == "score":
        path = evaluate(spark, args.prediction_path, args.metric_path, args.dataset_path, args.selected_metrics, args.model_name, args.split, args.target, args.fold, args.score_modes, args.variables)
    elif args.command == "train":
        settings = card_settings(spark, args.model_card_file, args.model) if args.model_card_file else {}
        path = train(spark, args.dataset_file, args.output_path, args.model, args.split, args.target, args.test_fold, settings)
    elif args.command == "datasets-list":
        path = datasets_list(spark, args.catalog, args.output_dir, args.manifest_dir)
    elif args.command == "aggregate":
        path = aggregate_run(spark, args.fold_documents, args.output_path)
    else:
        path = publish(spark, args.metric_dir, args.output_path, args.game)
    print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

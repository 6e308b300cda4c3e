"""Command line: ``python -m longspan COMMAND ...``; tables are Parquet folders or files."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="longspan")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (
        ("count", "mean tokens of each dataset's contexts"),
        ("split", "sentences of each context"),
        ("align", "token offsets of sentence ends"),
        ("align-report", "mean alignment quality by model and dataset"),
        ("evaluate", "all stages from corpus to score"),
        ("grade", "scores of generations and their macro means"),
    ):
        c = sub.add_parser(name, help=about)
        c.add_argument("--data", required=True, help="folder with the input tables")
        c.add_argument("--out", required=True, help="folder for the results")
        if name == "evaluate":
            c.add_argument("--budget", type=int, default=200)
            c.add_argument("--ratio", type=float, default=None)
            c.add_argument("--q-index", type=int, default=-1)
            c.add_argument("--questions", type=int, nargs="*", default=None)
            c.add_argument("--deferred", action="store_true", help="write requests instead of generating")
    args = p.parse_args(argv)

    from longspan.functions import text
    from longspan.operators import align, grade, lookup, report
    from longspan.plans import pipeline
    from longspan import session as sessions
    from longspan.sources import sinks
    from longspan.sources.tables import table

    spark = sessions.session()
    key = ["ds_name", "q_index"]
    if args.command == "count":
        counted = table(spark, args.data, "corpus", *key, "context").where("context is not null").select(*key, F.size(text.tokens("context")).alias("ntokens"))
        sinks.write_stage(counted, args.out, "token_counts")
        sinks.write_csv(report.mean_int(counted, "ds_name", "ntokens"), f"{args.out}/mean_tokens.csv")
    elif args.command == "split":
        rows = table(spark, args.data, "corpus", *key, "context")
        sinks.write_json(rows.select(*key, text.sentences("context").alias("target_sentences")), f"{args.out}/target_sentences.json")
    elif args.command == "align":
        rows = lookup.with_targets(table(spark, args.data, "corpus", *key, "context"), table(spark, args.data, "target_sentences"), key)
        sinks.write_stage(align.align_corpus(rows, key), args.out, "alignments")
    elif args.command == "align-report":
        means = report.mean_by(table(spark, args.data, "alignments"), ["model_name", "ds_name"], ["success_rate", "mean_dist", "non_zero_mean_dist"])
        sinks.write_csv(means, f"{args.out}/alignment_report.csv")
    elif args.command == "evaluate":
        corpus = lookup.select_questions(table(spark, args.data, "corpus"), args.q_index, args.questions)
        out = pipeline.evaluate(corpus, pipeline.Settings(budget=args.budget, compression_ratio=args.ratio, deferred=args.deferred), models=table(spark, args.data, "models"), datasets=table(spark, args.data, "datasets", "ds_name", "max_gen_len"))
        for name, df in out.items():
            sinks.write_stage(df, args.out, name)
        if args.deferred:
            sinks.append_jsonl(out["prompts"].select(*key, "model_name", F.col("input").alias("query"), F.col("answers").alias("truth"), "prompt"), f"{args.out}/requests.jsonl")
    else:
        rows = grade.grade(table(spark, args.data, "generations").dropDuplicates(["gen_id"]))
        sinks.write_stage(rows.select("gen_id", "model_name", "exp_type", "ds_name", "q_index", "score"), args.out, "graded")
        classes = table(spark, args.data, "datasets", "ds_name", "ds_class")
        sinks.write_csv(report.macro_mean(rows.join(classes, "ds_name"), ["model_name", "exp_type"], "ds_class", "ds_name", "score", 100.0), f"{args.out}/macro_means.csv")


if __name__ == "__main__":
    main()

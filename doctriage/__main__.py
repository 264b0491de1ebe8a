"""Command line: ``spark-submit -m doctriage <train|triage|watch|summary|log> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from doctriage.operators import model
from doctriage.plans import local, runs, training
from doctriage.sources.samples import read_samples


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="doctriage")
    jobs = top.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("train", help="fit, evaluate and save the classifier")
    train.add_argument("samples", help="folder with one text file per label")
    train.add_argument("model")
    triage = jobs.add_parser("triage", help="sort the files of a folder")
    triage.add_argument("uploads")
    triage.add_argument("root")
    triage.add_argument("--model")
    watch = jobs.add_parser("watch", help="sort files as they arrive")
    watch.add_argument("uploads")
    watch.add_argument("root")
    watch.add_argument("--model")
    watch.add_argument("--once", action="store_true", help="stop when all present files are done")
    for name, text in (("summary", "counters over all runs"), ("log", "reports of all runs")):
        jobs.add_parser(name, help=text).add_argument("root")
    return top


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("doctriage").getOrCreate()
    if given.job == "train":
        result = training.train(read_samples(spark, given.samples), given.model)
        print(f"accuracy: {result.accuracy * 100:.2f}%")
        result.report.show(truncate=False)
    elif given.job in ("triage", "watch"):
        settings = local.Settings(model=model.load(spark, given.model) if given.model else None)
        if given.job == "watch" and not given.once:
            runs.watch(spark, given.uploads, given.root, settings).awaitTermination()
        else:
            done = runs.run_folder(spark, given.uploads, given.root, settings)
            columns = ("file_name", "status", "document_type", "destination", "final_name")
            for row in done.orderBy("arrival_seq").select(*columns).toLocalIterator():
                print(*("-" if value is None else value for value in row), sep="\t")
    elif given.job == "summary":
        for table in runs.summary(spark, given.root):
            table.show()
    else:
        # The whole log, one partition at a time.
        for row in runs.log(spark, given.root).toLocalIterator():
            print(row["entry"])


if __name__ == "__main__":
    main()

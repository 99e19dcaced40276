"""python -m strandlake build | classify | profile: the engine from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake import engine
from strandlake.operators import profile
from strandlake.sources import files
from strandlake.sources.archive import Archive


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    b = kinds.add_parser("build", help="write an index")
    b.add_argument("--target", required=True, help="manifest of FASTA files and their nodes")
    b.add_argument("--taxonomy", required=True, help="tax.info: node, parent, rank, name")
    b.add_argument("--index", required=True)
    c = kinds.add_parser("classify", help="assign reads and write the tables")
    c.add_argument("--index", required=True)
    c.add_argument("--reads", required=True, help="FASTQ or FASTA files")
    c.add_argument("--out", required=True)
    p = kinds.add_parser("profile", help="the species profile of an evidence table")
    p.add_argument("--evidence", required=True)
    p.add_argument("--out", required=True)
    args = parser.parse_args(words)
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    if args.kind == "build":
        engine.build(spark, engine.references(spark, args.target, args.taxonomy), args.index)
    elif args.kind == "classify":
        engine.classify(spark, Archive(spark, args.index), engine.reads_of(spark, args.reads), args.out)
    else:
        counts = profile.legacy(files.evidence(spark.read.text(args.evidence)), "taxid", "count")
        files.profile_lines(counts).orderBy("at").select(F.col("line").alias("value")).coalesce(1).write.mode("error").text(args.out)  # a row a taxon


if __name__ == "__main__":
    main()

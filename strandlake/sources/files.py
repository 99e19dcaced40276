"""Text sources and sinks, each with its own schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.col("value")).alias("value"))


def manifest_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """(file, taxid, valid): the first two words of a line; a line with fewer is not valid."""
    words = F.split(F.trim(F.col(column)), "[ \\t]+")
    return df.select(F.try_element_at(words, F.lit(1)).alias("file"), F.try_element_at(words, F.lit(2)).alias("taxid"), (F.size(words) >= 2).alias("valid"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(spark.read.text(path)).where("valid").drop("valid")


def key_values(df: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of `key=value` lines; comments and blank lines are skipped."""
    text = F.trim(F.col(column))
    parts = F.split(text, "=", 2)
    return df.where((text != "") & ~text.startswith("#") & text.contains("=")).select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))


def nodes(df: DataFrame, column: str = "value") -> DataFrame:
    """(taxid, parent, rank) of nodes.dmp lines."""
    f = F.split(F.col(column), "\\t\\|\\t?")
    return df.select(F.get(f, F.lit(0)).cast("int").alias("taxid"), F.get(f, F.lit(1)).cast("int").alias("parent"), F.get(f, F.lit(2)).alias("rank"))


def names(df: DataFrame, column: str = "value") -> DataFrame:
    """(taxid, name) of the scientific names in names.dmp lines."""
    f = F.split(F.col(column), "\\t\\|\\t?")
    return df.where(F.get(f, F.lit(3)) == "scientific name").select(F.get(f, F.lit(0)).cast("int").alias("taxid"), F.get(f, F.lit(1)).alias("name"))


def tax_info(df: DataFrame, column: str = "value") -> DataFrame:
    """(node, parent, rank, name) of lines with at least four fields."""
    f = F.split(F.col(column), "\\t")
    return df.where(F.size(f) >= 4).select(*(F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("node", "parent", "rank", "name"))))


def evidence(df: DataFrame, column: str = "value") -> DataFrame:
    """(taxid, count) of `taxid<tab>count` lines with a positive count; the header and comments are skipped."""
    f = F.split(F.col(column), "\\t")
    count = F.try_element_at(f, F.lit(2)).try_cast("double")
    return df.where(~F.col(column).startswith("#") & (F.lower(F.get(f, F.lit(0))) != "taxid") & (count > 0)).select(F.get(f, F.lit(0)).alias("taxid"), count.alias("count"))


def krona_taxid(df: DataFrame, column: str = "value") -> DataFrame:
    """(taxid) of per-read lines: the first field after the id that isn't a `POST_` one, before its colon."""
    fields = F.filter(F.slice(F.split(F.col(column), "\\t"), 2, 1000), lambda x: ~x.startswith("POST_"))
    return df.select(F.get(F.split(F.try_element_at(fields, F.lit(1)), ":"), F.lit(0)).alias("taxid"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): records of FASTA files, plain or compressed; a record begins with `>` at a line's start, and files are split between records."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^\\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return raw.select(F.regexp_extract(head, "^[^ \\t\\r]*", 0).alias("seq_id"), F.upper(F.regexp_replace(body, "[ \\t\\r\\n]", "")).alias("seq"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_id, seq, ordinal): records of four lines; ordinals count from 0 in each file.

    Files are read split by split. A first pass counts each split's lines and takes the few
    at its ends; so a split knows its first line's number, and records that lie across
    splits are put together from the ends alone. An unfinished last record is left out.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
        """Each split's consecutive lines, a batch's at one time."""
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("file", "block", "value")]
            at = 0
            for k in range(1, batch.num_rows + 1):
                if k == batch.num_rows or (cols[0][k], cols[1][k]) != (cols[0][at], cols[1][at]):
                    yield (cols[0][at], cols[1][at]), cols[2][at:k]
                    at = k

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, list] = {}
        for key, part in splits(batches):
            n, head, tail = own.get(key, (0, [], []))
            own[key] = [n + len(part), (head + part[:3])[:3], (tail + part[-3:])[-3:]]
        rows = [(*key, *x) for key, x in own.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "n", "head", "tail"), r)) for r in rows], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))]))

    found = text.mapInArrow(ends, "file string, block long, n long, head array<string>, tail array<string>")
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))  # a row a split
    found = found.withColumn("base", F.coalesce(before, F.lit(0)))
    edge = found.select("file", "base", "n", F.posexplode("head").alias("p", "value")).withColumn("number", F.col("base") + F.col("p"))
    edge = edge.unionByName(found.select("file", "base", "n", F.size("tail").alias("t"), F.posexplode("tail").alias("p", "value")).withColumn("number", F.col("base") + F.col("n") - F.col("t") + F.col("p")).drop("t"))
    first = F.col("ordinal") * 4
    edge = edge.withColumn("ordinal", F.floor(F.col("number") / 4)).where((first < F.col("base")) | (first + 4 > F.col("base") + F.col("n"))).select("file", "ordinal", "number", "value").distinct()
    line = lambda k: F.max(F.when(F.col("number") % 4 == k, F.col("value")))
    across = edge.groupBy("file", "ordinal").agg(line(0).alias("head"), line(1).alias("seq"), F.count("*").alias("lines")).where("lines = 4").select("file", "ordinal", "head", "seq")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, number = None, [], 0
        for batch in batches:
            rows = []
            bases = dict(zip(zip(batch["file"].to_pylist(), batch["block"].to_pylist()), batch["base"].to_pylist()))
            for key, part in splits([batch]):
                if key != last:
                    skip = -bases[key] % 4
                    last, held, number = key, [], bases[key]
                    todo = skip
                while part and todo:
                    part, todo, number = part[1:], todo - 1, number + 1
                held += part
                for i in range(0, len(held) - 3, 4):
                    rows.append((key[0], (number + i) // 4, held[i], held[i + 1]))
                done = len(held) // 4 * 4
                held, number = held[done:], number + done
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "ordinal", "head", "seq"])

    inside = text.join(F.broadcast(found.select("file", "block", "base")), ["file", "block"]).select("value", "file", "block", "base").mapInArrow(whole, "file string, ordinal long, head string, seq string")  # a row a split
    return inside.unionAll(across).select("file", F.regexp_extract("head", "^@([^ \\t\\r]*)", 1).alias("seq_id"), F.upper(F.regexp_replace("seq", "[ \\t\\r]", "")).alias("seq"), "ordinal")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mates by ordinal; what one side has more of is left out; the id is that of mate 1."""
    r = right.select("ordinal", F.col("seq").alias("seq2"))
    return left.join(r, "ordinal").select("ordinal", "seq_id", "seq", "seq2")


def assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """The used columns of an assembly_summary file, comment lines skipped."""
    f = F.split("value", "\\t")
    used = {"accession": 0, "category": 4, "taxid": 5, "species_taxid": 6, "organism": 7, "strain": 8, "status": 10, "level": 11, "date": 14, "url": 19, "type_material": 21}
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(*(F.try_element_at(f, F.lit(i + 1)).alias(n) for n, i in used.items()))


def write_ragged(df: DataFrame, path: str, line: str) -> None:
    """One text line a row; `line` is an expression; the folder must not exist."""
    df.select(F.expr(line).alias("value")).write.mode("error").text(path)


def write_taxonomy(info: DataFrame, nodes_: DataFrame, folder: str) -> None:
    """`target.tsv` (file, node) and `tax.info` (node, parent, rank, name) folders, without headers."""
    info.select("file", "node").write.mode("error").csv(f"{folder}/target.tsv", sep="\t")
    nodes_.select("node", "parent", "rank", "name").write.mode("error").csv(f"{folder}/tax.info", sep="\t")


def profile_lines(counts: DataFrame, unit: str = "reads") -> DataFrame:
    """(at, line) of the legacy species profile from (taxon, count): comments, header, taxa by count, unclassified last, with per cent."""
    fixed = ["# profile_input=aggregate_evidence", f"# count_unit={unit}", "Taxon\tCount\tRelative Abundance (%)", "", "## Species Level ##"]
    head = counts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(fixed)], "at int, line string")
    last = (F.col("taxon") == "unclassified").cast("int")
    place = F.row_number().over(W.orderBy(last, F.desc("count"), "taxon")) + len(fixed) - 1  # a row a taxon
    share = F.format_string("%.2f", F.round(100 * F.col("count") / F.sum("count").over(W.partitionBy(F.lit(1))), 2))
    rows = counts.select("taxon", F.col("count").cast("double").alias("count")).select(place.alias("at"), F.concat_ws("\t", "taxon", F.col("count").cast("string"), share).alias("line"))
    return head.unionAll(rows)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("error").csv(path, sep="\t", header=True)

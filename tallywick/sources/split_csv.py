"""CSV files whose quoted fields may hold line ends, read by several tasks a file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Options that the split reader follows; any other goes to Spark's own reader.
FOLLOWED = {"header", "sep", "delimiter"}
WHERE = ["file", "block"]


def open_pattern(sep: str) -> str:
    """Matches a line that ends inside a quoted field, if it began outside one.
    A quote opens a field at its start only, two are one literal quote, and text
    behind a closing quote belongs to the field up to the next separator."""
    s = re.escape(sep)
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    return f'(?s)^(?:(?:{quoted}"(?:[^"{s}][^{s}]*+)?+|(?!")[^{s}]*+){s})*+{quoted}(?!.)'


def lines(spark: SparkSession, path) -> DataFrame:
    """value, file, block of every line; a split's lines stay in the file's order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """The batches of each (file, block) in turn."""

    def pieces():
        for b in batches:
            if not b.num_rows:
                continue
            ends = pa.concat_arrays([pc.run_end_encode(b.column(c)).run_ends for c in WHERE]).unique().sort().to_pylist()
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                yield b.slice(begin, end - begin)

    return groupby(pieces(), key=lambda b: tuple(b.column(c)[0].as_py() for c in WHERE))


def ends_of(sep: str):
    """Per (file, block): is a quote open at its end if none was at its start, and
    if one was."""
    opened = re.compile(open_pattern(sep)).search

    def run(batches):
        for (file, block), part in _runs(batches):
            state = [False, True]
            for b in part:
                value = b.column("value")
                for line in value.filter(pc.match_substring(value, '"')).to_pylist():
                    line = line.removesuffix("\r")
                    after = opened(line) is not None, opened('"' + line) is not None
                    state = [after[s] for s in state]
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "from_out": state[0], "from_in": state[1]}])

    return run


def split_states(rows: DataFrame, sep: str) -> DataFrame:
    """file, block, opens (the split starts inside a quoted field), closes (it ends
    inside one): one row a split, 128 MB of a large file.  Of the two ends that a
    split can have, those that don't depend on its start decide; behind one that
    does, the state is kept or turned."""
    ends = rows.mapInArrow(ends_of(sep), "file string, block long, from_out boolean, from_in boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("from_out") == F.col("from_in")
    turns = F.sum((~fixed & F.col("from_out")).cast("int")).over(before)
    last = F.last(F.when(fixed, F.struct("from_out", F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    state = F.coalesce(F.col("last.from_out"), F.lit(False)) != ((F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1)
    closes = ends.withColumn("turns", turns).withColumn("last", last).withColumn("closes", state)
    opens = F.coalesce(F.lag("closes").over(Window.partitionBy("file").orderBy("block")), F.lit(False))
    return closes.withColumn("opens", opens).select(*WHERE, "opens", "closes")


def records_of(sep: str, fragments: bool):
    """The records of a split that begin and end in it, or the ``fragments`` at its
    two borders: part 0 ends a record of an earlier split (or runs through), part 1
    begins one that goes on."""
    opened = re.compile(open_pattern(sep)).search

    def batch(file, block, part, texts, first):
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string()), pa.array([first and i == 0 for i in range(n)], pa.bool_())],
            ["file", "block", "part", "record", "first"],
        )

    def run(batches):
        for (file, block), part in _runs(batches):
            inside, held, head, at_start = None, [], False, block == 0
            for b in part:
                if inside is None:
                    inside = b.column("opens")[0].as_py()
                    if inside is None:
                        raise RuntimeError(f"{file}: splits have changed since they were counted")
                    head = inside
                done = []
                for line in b.column("value").to_pylist():
                    if inside or '"' in line:
                        bare = line.removesuffix("\r")
                        inside = opened('"' + bare if inside else bare) is not None
                    held.append(line)
                    if not inside:
                        text, held = "\n".join(held).removesuffix("\r"), []
                        if not head:
                            done.append(text)
                        elif fragments:
                            yield batch(file, block, 0, [text], False)
                        head = False
                if done:
                    if not fragments:
                        yield batch(file, block, 0, done, at_start)
                    at_start = False
            if held and fragments:
                yield batch(file, block, 0 if head else 1, ["\n".join(held)], at_start and not head)

    return run


RECORD = "file string, block long, part int, record string, first boolean"


def split_records(spark: SparkSession, path, sep: str) -> DataFrame:
    """record, first (of its file) of every record.  States of splits, one row
    for each, are broadcast; only splits at whose border a quote is open are read
    again for the pieces there, and those pieces, at most two a split, are shuffled."""
    rows = lines(spark, path)
    states = split_states(rows, sep)
    whole = rows.join(F.broadcast(states), WHERE, "left").mapInArrow(records_of(sep, False), RECORD)
    bordering = rows.join(F.broadcast(states.where("opens or closes")), WHERE).mapInArrow(records_of(sep, True), RECORD)
    order = Window.partitionBy("file").orderBy("block", "part")
    chained = bordering.withColumn("begun", F.last(F.when(F.col("part") == 1, F.col("block")), ignorenulls=True).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("block", "part", "record")))
    joined = chained.groupBy("file", "begun").agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"), F.max("first").alias("first"))
    return whole.select("record", "first").unionByName(joined.select(F.regexp_replace("record", "\r$", "").alias("record"), "first"))


def read_csv(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """Text columns of CSV files with quoted fields, the rows that Spark's reader
    gives with ``multiLine``.

    Where no line ends inside a quoted field (one pass decides), that is its line
    reader.  Otherwise each split is read by its own task once the splits' states
    are known.  Options other than ``FOLLOWED``, and separators of several
    characters, go to Spark's reader with ``multiLine``: one task a file.  Files of
    lone carriage returns as line ends are one task too.  Records that don't close
    their last quote run to the file's end; lines of blanks are no rows.  No files: an error of Spark's; a file
    with a header only: no rows."""
    given = {"header": True} | (options or {})
    base = {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    whole = spark.read.options(**({"multiLine": True} | base | given)).csv(path)
    sep = given.get("sep", given.get("delimiter", ","))
    if set(given) - FOLLOWED or len(sep) != 1 or sep == '"':
        return whole
    bare = F.regexp_replace("value", "\r$", "")
    opens = F.contains("value", F.lit('"')) & bare.rlike(open_pattern(sep))
    seen = lines(spark, path).agg(F.max(opens).alias("opens"), F.max(F.col("value").rlike("(?s)\r.")).alias("returns")).first()
    if not seen.opens:
        return spark.read.options(**base | given).schema(whole.schema).csv(path)
    if seen.returns:
        return whole
    found = split_records(spark, path, sep)
    if str(given["header"]).lower() == "true":
        found = found.where("not first")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in whole.columns)
    return found.where(F.trim("record") != "").select(F.from_csv("record", schema, {**base, "sep": sep}).alias("r")).select("r.*")

r"""Cut CSV files into records by many tasks, line breaks inside quotes included.

A file is read as lines in byte ranges.  Whether a line begins inside a quoted field
depends on all lines before it, but a range as a whole does one of four things to that
state: keep it, turn it over, or end inside or outside whatever it was.  A first pass over
the lines reports this for each range; a running sum over the ranges of a file (a row for
each) gives every range its true state.  A second pass cuts each range into records, one
line or more.  Only what crosses the border of ranges is shuffled and joined.

Quotes open a field only at its beginning and are doubled inside, as in RFC 4180; a quote
anywhere else is a character like others.  Lines end in ``\n`` or, where a file's first one
does, in ``\r\n``, which fields then have as ``\n``.  The lines of a
task come as Arrow batches: built-in functions have no running state over the rows of a
task without a shuffle of all text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.session import broadcast_if_bounded, staged

#: Characters of a record, at most: a quote that is not closed by then is an error.
MAX_RECORD = 16_000_000

# What a piece of a range is: a whole record, or the end, the beginning or the middle of one.
WHOLE, END, BEGIN, MIDDLE = range(4)


class Quotes:
    """Whether a line that begins inside or outside a quoted field ends inside one."""

    def __init__(self, delimiter: str = ","):
        d = re.escape(delimiter)
        # up to the next quote that opens a field, or to the end of the line
        self.outside = re.compile(rf'(?:[^{d}"][^{d}]*)?(?:{d}(?:[^{d}"][^{d}]*)?)*(")?')
        # up to the quote that closes the field, and on to the field's end
        self.inside = re.compile(rf'[^"]*(?:""[^"]*)*("[^{d}"]*[^{d}]*{d}?)?')

    def ends_inside(self, line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                found = self.inside.match(line, at)
                if found[1] is None:
                    return True
                inside, at = False, found.end()
            found = self.outside.match(line, at)
            if found[1] is None:
                return False
            inside, at = True, found.end()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of lines of one range, and whether the range begins there."""
    before = None
    for batch in batches:
        blocks, files = batch.column("block"), batch.column("file").dictionary_encode().indices
        cuts = [0]
        if batch.num_rows > 1:
            new = pc.or_(pc.not_equal(blocks[1:], blocks[:-1]), pc.not_equal(files[1:], files[:-1]))
            cuts += (pc.indices_nonzero(new).to_numpy() + 1).tolist()
        for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            if end > at:
                part = batch.slice(at, end - at)
                key = part.column("file")[0].as_py(), part.column("block")[0].as_py()
                yield key != before, part
                before = key


def _quoted(part: pa.RecordBatch) -> list[tuple[int, str]]:
    """The lines that have a quote, with their places."""
    places = pc.indices_nonzero(pc.match_substring(part.column("value"), '"'))
    return list(zip(places.to_pylist(), part.column("value").take(places).to_pylist()))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, block``: lines, and the byte range each of them begins in."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def range_states(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """``file, block, inside``: whether a range begins inside a quoted field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, done, ends = Quotes(delimiter), [], None
        for new, part in _runs(batches):
            if new:
                ends = {"file": part.column("file")[0].as_py(), "block": part.column("block")[0].as_py(), "outside": 0, "inside": 1}
                done.append(ends)
            for _, line in _quoted(part):
                for start in ("outside", "inside"):
                    ends[start] = int(quotes.ends_inside(line, bool(ends[start])))
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32())]))

    ranges = lines.mapInArrow(run, "file string, block long, outside int, inside int")
    turns = (F.col("outside") == 1) & (F.col("inside") == 0)
    in_file = W.partitionBy("file").orderBy("block")
    upto, before = in_file.rowsBetween(W.unboundedPreceding, 0), in_file.rowsBetween(W.unboundedPreceding, -1)
    turned = ranges.withColumn("turns", F.sum(turns.cast("int")).over(upto))
    # a range that ends one way whatever it began with sets the state; turns from there on count
    fixed = F.when(F.col("outside") == F.col("inside"), F.pmod(F.col("outside") + F.col("turns"), F.lit(2)))
    state = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.max("turns").over(before), F.lit(0))
    return turned.select("file", "block", (F.pmod(state, F.lit(2)) == 1).alias("inside"))


def csv_records(spark: SparkSession, path: str, delimiter: str = ",", max_record: int = MAX_RECORD) -> DataFrame:
    """``record, first``: the records of CSV files, and whether each is the first of its file; empty lines are left out."""
    lines = lines_of(spark, path)
    states = staged(range_states(lines, delimiter), "range-states")
    n_ranges = states.count()
    near = broadcast_if_bounded(states, n_ranges)
    placed = lines.withColumn("at", F.monotonically_increasing_id()).join(near, ["file", "block"])
    if near is states:  # too many ranges to send to all tasks: deal the lines, and put them in order again
        placed = placed.repartition("file", "block").sortWithinPartitions("file", "block", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, held, size, inside, kind, key = Quotes(delimiter), [], 0, False, WHOLE, None

        def out(records: list[str], kinds: list[int]) -> pa.RecordBatch:
            n = len(records)
            columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(records, pa.string()), pa.array(kinds, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "record", "kind"])

        def hold(some: list[str]) -> None:
            nonlocal size
            held.extend(some)
            size += sum(map(len, some))
            if size > max_record:
                raise ValueError(f"{key[0]}: a quote is not closed within {max_record} characters, after byte {key[1]}")

        def border() -> Iterator[pa.RecordBatch]:
            if held:
                yield out(["\n".join(held)], [MIDDLE if kind == END else BEGIN])

        for new, part in _runs(batches):
            if new:
                yield from border()
                held, size = [], 0
                key = part.column("file")[0].as_py(), part.column("block")[0].as_py()
                inside = part.column("inside")[0].as_py()
                kind = END if inside else WHOLE
            values, at = part.column("value"), 0
            records, kinds = [], []
            for place, line in _quoted(part):
                after = quotes.ends_inside(line, inside)
                if after != inside or held:
                    plain = values.slice(at, place - at).to_pylist()
                    if inside:
                        hold([*plain, line])
                    else:
                        records += plain
                        kinds += [WHOLE] * len(plain)
                        hold([line])
                    if not after:
                        records.append("\n".join(held))
                        kinds.append(kind)
                        held, size, kind = [], 0, WHOLE
                    at = place + 1
                inside = after
            rest = values.slice(at).to_pylist()
            if inside:
                hold(rest)
            else:
                records += rest
                kinds += [WHOLE] * len(rest)
            yield out(records, kinds)
        yield from border()

    pieces = placed.select("value", "file", "block", "inside").mapInArrow(cut, "file string, block long, record string, kind int")
    pieces = staged(pieces.withColumn("at", F.monotonically_increasing_id()), "csv-records")
    # a file's first record is the first piece of its first range; its end tells how the file's lines end
    whole = F.col("record").endswith("\r")
    firsts = pieces.where("block = 0").groupBy("file").agg(F.min("at").alias("head"), F.min_by(whole, "at").alias("crlf"))
    pieces = pieces.join(broadcast_if_bounded(firsts, n_ranges), "file", "left").withColumn("first", F.col("at") == F.col("head"))
    number = F.sum((F.col("kind") == BEGIN).cast("int")).over(W.partitionBy("file").orderBy("block", "at"))
    crossing = pieces.where(F.col("kind") != WHOLE).withColumn("number", number)
    lengths = crossing.groupBy("file", "number").agg(F.sum(F.length("record")).alias("n"), F.min("block").alias("block"))
    endless = lengths.where(F.col("n") > max_record).first()
    if endless:
        raise ValueError(f"{endless.file}: a quote is not closed within {max_record} characters, after byte {endless.block}")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "record")))
    joined = crossing.groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.max("first").alias("first"), F.first("crlf").alias("crlf")
    )
    records = pieces.where(F.col("kind") == WHOLE).select("record", "first", "crlf").unionByName(joined.select("record", "first", "crlf"))
    unified = F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), r"\r$", "")
    return records.select(F.when(F.col("crlf"), unified).otherwise(F.col("record")).alias("record"), "first").where(F.col("record") != "")

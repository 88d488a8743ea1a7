"""Commits from exported ``git log`` text.

Expected format: ``--numstat -p --no-merges --format=%x1e%H%x1f%aI%x1f%an%x1f%s%x1f%b%x1e``.
An export may be one large file: it is read in splits at the record mark, and what a split's border
cuts apart is paired again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.functions.text import trim_end, trim_space


def _fail(message: str, detail: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), detail))


def _once(frame: DataFrame, *columns: Column) -> DataFrame:
    """The columns, each worked out once a row: a plain projection is repeated for every later use."""
    return frame.select(F.inline(F.array(F.struct(*columns))))


def patch_place(chunk: Column) -> Column:
    """Where the first patch header is, from 1; 0 without one."""
    return F.regexp_instr(chunk, F.lit(r"(?m)^diff --git "))


def split_tail(chunk: Column, at: Column) -> Column:
    """``struct(numstat, diff)``: what follows a header, cut at the first patch header."""
    return F.struct(
        F.when(at > 0, F.substring(chunk, F.lit(1), at - 1)).otherwise(chunk).alias("numstat"),
        F.when(at > 0, trim_end(F.substring(chunk, at, F.length(chunk))))
        .otherwise("")
        .alias("diff"),
    )


def _count(raw: Column) -> Column:
    return F.when(raw == "-", F.lit(None).cast("int")).otherwise(
        F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).otherwise(
            _fail("commit export: bad line count: ", raw).cast("int")
        )
    )


def parse_numstat(block: Column) -> Column:
    """Array of changed files; ``-`` counts (binary files) are NULL, other text fails."""
    lines = F.filter(F.transform(F.split(block, "\n"), trim_space), lambda line: line != "")
    rows = F.transform(lines, lambda line: F.split(line, "\t", 3))

    def one(parts: Column) -> Column:
        path = F.get(parts, 2)
        good = F.when(F.length(path) > 0, path).otherwise(
            _fail("commit export: bad file line: ", F.array_join(parts, "\t"))
        )
        return F.struct(
            good.alias("path"), _count(parts[0]).alias("added"), _count(F.get(parts, 1)).alias("deleted")
        )

    return F.transform(rows, one)


def _of_exports(exports: DataFrame, text: str) -> DataFrame:
    """``record`` (header and tail) of rows that each hold one whole export."""
    chunks = exports.select(F.split(F.col(text), V.GIT_RECORD).alias("chunks"))
    return chunks.select(
        F.explode(
            F.transform(
                F.when(F.size("chunks") > 1, F.sequence(F.lit(1), F.size("chunks") - 1, F.lit(2)))
                .otherwise(F.array().cast("array<int>")),
                lambda i: F.struct(
                    F.get(F.col("chunks"), i).alias("header"),
                    F.coalesce(F.get(F.col("chunks"), i + 1), F.lit("")).alias("tail"),
                ),
            )
        ).alias("record")
    )


def _parsed(records: DataFrame) -> DataFrame:
    """Parsed records, with ``reason`` where one is over a limit."""
    header = F.col("record.header")
    good = header.rlike(rf"^[0-9a-f]{{40}}{V.GIT_UNIT}") & (F.size(F.split(header, V.GIT_UNIT)) >= 5)
    parts = F.split(
        F.when(good, header).otherwise(_fail("commit export: bad record header: ", header)), V.GIT_UNIT, 5
    )
    cut = _once(
        records, parts.alias("p"), F.col("record.tail").alias("tail"), patch_place(F.col("record.tail")).alias("patch_at")
    )
    parsed = _once(cut, "p", split_tail(F.col("tail"), F.col("patch_at")).alias("t"))
    at = F.try_to_timestamp(F.col("p")[1])
    unpacked = _once(
        parsed,
        F.col("p")[0].alias("sha"),
        F.coalesce(at, _fail("commit export: bad date: ", F.col("p")[1]).cast("timestamp")).alias("committed_at"),
        F.col("p")[2].alias("author"),
        F.col("p")[3].alias("subject"),
        trim_space(F.col("p")[4]).alias("body"),
        parse_numstat(F.col("t.numstat")).alias("files"),
        F.col("t.diff").alias("diff"),
    )
    over = [
        F.when(F.length(name) > limit, F.lit(f"{name}: over {limit} characters")) for name, limit in _LIMITS.items()
    ]
    return unpacked.withColumn(
        "reason",
        F.coalesce(
            *over,
            F.when(F.size("files") > MOST_FILES, F.lit(f"files: over {MOST_FILES}")),
            F.when(
                F.exists("files", lambda f: F.length(f["path"]) > MOST_PATH), F.lit(f"files: a path over {MOST_PATH} characters")
            ),
        ),
    )


_LIMITS = {"author": 200, "subject": 500, "body": 4000}
MOST_FILES = 200
MOST_PATH = 400


_WHOLE, _TAIL, _HEADER, _BEGINS = 0, 1, 2, 3
_PIECES = "file string, start bigint, kind int, header string, tail string"


def _frame_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs headers with the tails behind them, as chunks of a split come in their order.

    What lies in another split stays a piece: a tail at the start of a split, a header at its end.
    A split that begins with a header says so, as then none may be open before it.
    """
    is_header = re.compile(rf"[0-9a-f]{{40}}{V.GIT_UNIT}").match
    at, open_, rows = None, None, []

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(made, names=["file", "start", "kind", "header", "tail"])

    for batch in batches:
        for chunk, *split in zip(*[batch.column(c).to_pylist() for c in ("value", "file", "start")], strict=True):
            if split != at:
                if open_ is not None:
                    rows.append((*at, _HEADER, open_, None))
                at, open_ = split, None
                if split[1] == 0:
                    continue  # before the first mark
                if is_header(chunk):
                    rows.append((*at, _BEGINS, None, None))
                    open_ = chunk
                else:
                    rows.append((*at, _TAIL, None, chunk))
            elif open_ is None:
                open_ = chunk  # checked when it is parsed
            else:
                rows.append((*at, _WHOLE, open_, chunk))
                open_ = None
        yield flush()
    if open_ is not None:
        rows.append((*at, _HEADER, open_, None))
    yield flush()


def _of_files(spark: SparkSession, path: str) -> DataFrame:
    """``record`` of every record of export files, which several tasks may read."""
    chunks = spark.read.option("lineSep", V.GIT_RECORD).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    framed = chunks.mapInArrow(_frame_chunks, _PIECES)
    # At most three small rows a split: they show whether the splits of a file fit together.
    in_order = Window.partitionBy("file").orderBy("start", "_rank")
    pieces = framed.where(F.col("kind") != _WHOLE).withColumn(
        "_rank", F.when(F.col("kind") == _HEADER, 1).otherwise(0)
    )
    pieces = pieces.select(
        "kind", "header", "tail", F.lag("kind").over(in_order).alias("_before"),
        F.lead("kind").over(in_order).alias("_after"), F.lead("tail").over(in_order).alias("_next"),
    )
    fits = (
        F.when(F.col("kind") == _TAIL, F.coalesce(F.col("_before") == _HEADER, F.lit(False)))
        .when(F.col("kind") == _HEADER, F.coalesce(F.col("_after") == _TAIL, F.lit(True)))
        .otherwise(F.lit(True))
    )
    bad = _fail("commit export: bad record header: ", F.substring(F.coalesce("tail", "header", F.lit("")), 1, 200))
    # The filter looks at every piece, so one that does not fit ends the job.
    kind = F.when(fits, F.col("kind")).otherwise(bad.cast("int"))
    paired = pieces.where(kind == _HEADER).select(F.struct("header", F.coalesce("_next", F.lit("")).alias("tail")).alias("record"))
    return framed.where(F.col("kind") == _WHOLE).select(F.struct("header", "tail").alias("record")).unionByName(paired)


def parse_git_log(exports: DataFrame, text: str = "value") -> DataFrame:
    """Commits from rows that each hold one whole export.

    A commit over a limit is left out, see :func:`oversized_commits`. Malformed framing fails the
    job, as what follows it could not be trusted.
    """
    return _within_limits(_parsed(_of_exports(exports, text)))


def _within_limits(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def oversized_commits(exports: DataFrame, text: str = "value") -> DataFrame:
    """``sha, reason`` of the commits that :func:`parse_git_log` leaves out."""
    return _parsed(_of_exports(exports, text)).where(F.col("reason").isNotNull()).select("sha", "reason")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of export files of any size, each read by as many tasks as it has splits."""
    return _within_limits(_parsed(_of_files(spark, path)))

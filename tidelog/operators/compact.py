"""Compaction of a log, and the planning of it over a table of files.

Files: (level, file_no, file_size, smallest, largest). Level 0 may overlap; deeper levels
are disjoint. File tables are metadata, one row for each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE, LEVELS
from . import ordered

# When a level is due, and how much of the next level one output may overlap.
LEVEL0_FILES = 4
LEVEL1_BYTES = 10 * 1048576
OUTPUT_BYTES = 2 * 1048576
DEEPEST_FLUSH = 2
GRANDPARENT_OUTPUTS = 10


def newer_seq(log: DataFrame) -> DataFrame:
    """Each entry with the seq of the next newer entry of its key, kept or not."""
    return log.withColumn("newer_seq", F.lag("seq").over(Window.partitionBy("k").orderBy(F.desc("seq"))))


def drop_hidden(log: DataFrame, oldest: int) -> DataFrame:
    """Rule A: an entry goes if a newer one of its key is visible to the oldest snapshot."""
    return newer_seq(log).where(F.col("newer_seq").isNull() | (F.col("newer_seq") > oldest)).drop("newer_seq")


def drop_tombstones(log: DataFrame, oldest: int, deeper: DataFrame | None) -> DataFrame:
    """Rule B: a tombstone goes if the oldest snapshot sees it and no deeper file's range holds its key."""
    gone = (F.col("op") == DELETE) & (F.col("seq") <= oldest)
    if deeper is None:
        return log.where(~gone)
    kept = ordered.covered(log.where(gone), deeper).where("covered").drop("covered")
    return log.where(~gone).unionByName(kept)


def compact(log: DataFrame, oldest: int, deeper: DataFrame | None = None) -> DataFrame:
    """Entries that survive: reads at any snapshot >= oldest see the same as before.

    A tombstone is judged after the entries it hides, so rule B never uncovers them.
    """
    return drop_tombstones(drop_hidden(log, oldest), oldest, deeper)


def overlapping(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, level, file_no, ...) of files that meet each range; a null bound is open. Both are metadata."""
    meets = (F.col("end").isNull() | (F.col("smallest") <= F.col("end"))) & (F.col("begin").isNull() | (F.col("largest") >= F.col("begin")))
    return ranges.join(files, meets)


def closure(files: DataFrame, begin, end) -> list[int]:
    """Level-0 files that meet [begin, end], and those that meet them, to a fixed point.

    Runs over the file table of one level, which the planner holds anyway.
    """
    rows = [(r["file_no"], r["smallest"], r["largest"]) for r in files.where("level = 0").select("file_no", "smallest", "largest").collect()]
    taken: set[int] = set()
    while True:
        new = {n for n, a, b in rows if (end is None or a <= end) and (begin is None or b >= begin)}
        if new == taken:
            return sorted(taken)
        taken = new
        low, high = min(a for n, a, _ in rows if n in taken), max(b for n, _, b in rows if n in taken)
        begin = low if begin is None else min(begin, low)
        end = high if end is None else max(end, high)


def _chained(rows: DataFrame, order: list[str]) -> DataFrame:
    """Files dealt by their order with ``_taken``: whether a file with ``_mark`` stands at or before it in its chain.

    A chain goes on where a file starts with the key that the one before it ends with.
    """
    within, ranges = Window.partitionBy("_part").orderBy(*order), Window.orderBy("_part")
    end = F.struct("largest", "largest_seq")
    ends = rows.groupBy("_part").agg(F.max_by(end, F.struct(*order)).alias("_end"))
    rows = rows.join(F.broadcast(ends.select("_part", F.lag("_end").over(ranges).alias("_end"))), "_part")
    rows = rows.withColumn("_before", F.coalesce(F.lag(end).over(within), "_end")).withColumn("_n", F.col("_part") * F.lit(1 << 40) + F.row_number().over(within))
    goes_on = (F.col("smallest") == F.col("_before.largest")) & (F.col("smallest_seq") < F.col("_before.largest_seq"))
    rows = rows.withColumn("_chain", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("_n"))).withColumn("_mark", F.when(F.col("_mark"), F.col("_n"))).drop("_before", "_end")
    carried = rows.groupBy("_part").agg(*[F.max(c).alias(c) for c in ("_chain", "_mark")])
    carried = carried.select("_part", *[F.max(c).over(ranges.rowsBetween(*ordered.BEFORE)).alias(f"_carry{c}") for c in ("_chain", "_mark")])
    rows = rows.join(F.broadcast(carried), "_part")
    chain, mark = (F.greatest(F.max(c).over(within.rowsBetween(*ordered.UPTO)), f"_carry{c}") for c in ("_chain", "_mark"))
    return rows.withColumn("_taken", F.coalesce(mark >= chain, F.lit(False)))


def boundary_inputs(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Files of the level that go on with a key at which a chosen one of them ends, to a fixed point.

    Files here have (smallest, largest, smallest_seq, largest_seq): the entry each starts
    and ends with. Without them, older versions of that key would stay above newer ones.

    In a level whose files don't overlap, these are the rest of the chosen ones' chains.
    Where files overlap, one may go on with another that isn't the one before it; rounds
    follow until none does.
    """
    order = ["smallest", "_down", "file_no"]
    rows = ordered.dealt(files.withColumn("_down", -F.col("smallest_seq")), order)
    marks = chosen.select("file_no").distinct()
    while True:
        got = _chained(rows.join(marks.withColumn("_mark", F.lit(True)), "file_no", "left"), order).select(*files.columns, "_taken").persist()
        edges = got.where("_taken").groupBy(F.col("largest").alias("edge")).agg(F.max("largest_seq").alias("edge_seq"))
        more = got.where("NOT _taken").join(edges, (F.col("smallest") == F.col("edge")) & (F.col("smallest_seq") < F.col("edge_seq")), "left_semi")
        if more.isEmpty():
            return got.where("_taken").drop("_taken")
        marks = got.where("_taken").select("file_no").union(more.select("file_no"))


def flush_level(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, level) for new runs (run_id, smallest, largest): as deep as nothing overlaps, 2 at most."""
    meets = runs.select("run_id", F.col("smallest").alias("a"), F.col("largest").alias("b")).join(files, (F.col("smallest") <= F.col("b")) & (F.col("largest") >= F.col("a")), "left")
    blocked = meets.groupBy("run_id").agg(F.min(F.coalesce("level", F.lit(LEVELS))).alias("first"))
    return blocked.select("run_id", F.greatest(F.lit(0), F.least(F.lit(DEEPEST_FLUSH), F.col("first") - 1)).cast("long").alias("level"))


def scores(files: DataFrame) -> DataFrame:
    """(level, files, bytes, score); a level with a score of 1 or more is due."""
    per = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("files") / float(LEVEL0_FILES)).otherwise(F.col("bytes") / (LEVEL1_BYTES * F.pow(F.lit(10.0), F.col("level") - 1)))
    return per.withColumn("score", score)


def candidate(files: DataFrame, pointers: DataFrame) -> DataFrame:
    """File to compact next: of the level with the largest score, the first behind its pointer, else the first.

    Pointers: (level, pointer), the largest key compacted last; levels without one start at their first file.
    """
    due = scores(files).where((F.col("score") >= 1) & (F.col("level") < LEVELS - 1)).orderBy(F.desc("score"), "level").limit(1).select("level")
    return next_file(files.join(due, "level"), pointers)


def next_file(files: DataFrame, pointers: DataFrame) -> DataFrame:
    """Of one level's files the first behind its pointer, else the first, whether the level is due or not."""
    rows = files.join(pointers, "level", "left")
    behind = F.when(F.col("pointer").isNull() | (F.col("largest") > F.col("pointer")), 0).otherwise(1)
    return rows.withColumn("_behind", behind).orderBy("_behind", "smallest", "file_no").limit(1).drop("_behind", "pointer")


def is_trivial_move(inputs: int, next_inputs: int, grandparent_bytes: int) -> bool:
    """Whether one file can move down by a change of metadata alone."""
    return inputs == 1 and next_inputs == 0 and grandparent_bytes <= GRANDPARENT_OUTPUTS * OUTPUT_BYTES


def grandparent_groups(files: DataFrame, most: int = GRANDPARENT_OUTPUTS * OUTPUT_BYTES) -> DataFrame:
    """Files of a level in key order with the output that overlaps them: a new one each ``most`` bytes."""
    rows = ordered.running(files, ["smallest", "file_no"], "file_size", "upto")
    return rows.withColumn("output", F.floor((F.col("upto") - F.col("file_size")) / F.lit(most)).cast("long"))

"""Point, bulk, range, neighbour, history, as-of and difference reads of a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE, PUT
from . import ordered
from .resolve import at_snapshot, live, live_keys, resolve

FOUND, DELETED, ABSENT = "FOUND", "DELETED", "ABSENT"


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The live entry of one key, or no row."""
    return live(log.where(F.col("k") == F.lit(key)), snapshot)


def three_state(log: DataFrame, requests: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Each requested key with FOUND, DELETED or ABSENT, and its value."""
    newest = resolve(log, snapshot).select("k", "op", "v")
    state = F.when(F.col("op").isNull(), ABSENT).when(F.col("op") == DELETE, DELETED).otherwise(FOUND)
    return requests.join(newest, "k", "left").select("k", state.alias("state"), "v")


def hits(log: DataFrame, requests: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live entries of requested keys; the log shrinks to them before it is resolved."""
    return live(log.join(requests.select("k"), "k", "left_semi"), snapshot)


def misses(log: DataFrame, requests: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Requested keys without a live entry. The log shrinks to requested keys first; both joins read one exchange of them."""
    asked = log.join(requests.select("k"), "k", "left_semi")
    return requests.join(live_keys(asked, snapshot), "k", "left_anti")


def entries(log: DataFrame, low=None, high=None, prefix: str | None = None, after=None) -> DataFrame:
    """All entries with low <= k < high, the prefix, and k > after: versions and tombstones."""
    for condition in (
        None if low is None else F.col("k") >= F.lit(low),
        None if high is None else F.col("k") < F.lit(high),
        None if after is None else F.col("k") > F.lit(after),
        None if prefix is None else F.startswith(F.col("k"), F.lit(prefix)),
        None if prefix is None else F.col("k") >= F.lit(prefix),  # prunes by file statistics
    ):
        log = log if condition is None else log.where(condition)
    return log


def scan(log: DataFrame, low=None, high=None, prefix: str | None = None, after=None, snapshot: int | None = None) -> DataFrame:
    """The live ones of these entries; order is the caller's."""
    return live(entries(log, low, high, prefix, after), snapshot)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def seek(entries: DataFrame, probes: Sequence, forward: bool = True) -> DataFrame:
    """(probe, k): first key >= probe, or last key < probe; k is null past the end.

    One aggregate for each probe in a single pass: nothing but partial minima is shuffled.
    """
    k = F.col("k")
    found = [F.min(F.when(k >= F.lit(p), k)) if forward else F.max(F.when(k < F.lit(p), k)) for p in probes]
    row = entries.agg(*[f.alias(f"p{i}") for i, f in enumerate(found)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), F.col(f"p{i}").alias("k")) for i, p in enumerate(probes)])).alias("r")).select("r.probe", "r.k")


def neighbours(entries: DataFrame) -> DataFrame:
    """Live keys with the key before and after each."""
    return ordered.neighbours(entries)


def bounds(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"))


def chain(log: DataFrame) -> DataFrame:
    """Every version with the sequence at which it ends (null: still newest)."""
    return log.withColumn("until_seq", F.lead("seq").over(Window.partitionBy("k").orderBy("seq")))


def history(log: DataFrame) -> DataFrame:
    """Every version of each key, newest first, as one array; for keys whose versions fit a row."""
    newest_first = F.transform(F.sort_array(F.collect_list(F.struct("seq", "op", "v")), asc=False), lambda x: x)
    return log.groupBy("k").agg(newest_first.alias("versions"))


def live_counts(log: DataFrame, snapshots: Sequence[int]) -> DataFrame:
    """(snapshot, live_keys) for each snapshot, in one pass over the versions' validity."""
    versions = chain(log).where(F.col("op") == PUT)
    alive = lambda s: F.sum(F.when((F.col("seq") <= s) & (F.col("until_seq").isNull() | (F.col("until_seq") > s)), 1).otherwise(0))
    row = versions.agg(*[alive(s).alias(f"s{i}") for i, s in enumerate(snapshots)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("snapshot"), F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("long").alias("live_keys")) for i, s in enumerate(snapshots)])).alias("r")).select("r.*")


def difference(log: DataFrame, old: int, new: int) -> DataFrame:
    """(k, change, old_v, new_v) between two snapshots: both resolved in one aggregation."""
    version = F.struct("seq", "op", "v")
    both = at_snapshot(log, max(old, new)).groupBy("k").agg(F.max(F.when(F.col("seq") <= old, version)).alias("a"), F.max(F.when(F.col("seq") <= new, version)).alias("b"))
    was, is_ = F.coalesce(F.col("a.op") == PUT, F.lit(False)), F.coalesce(F.col("b.op") == PUT, F.lit(False))
    change = F.when(is_ & ~was, "ADDED").when(was & ~is_, "REMOVED").when(was & is_ & (F.col("a.seq") != F.col("b.seq")), "CHANGED")
    return both.select("k", change.alias("change"), F.when(was, F.col("a.v")).alias("old_v"), F.when(is_, F.col("b.v")).alias("new_v")).where("change IS NOT NULL")


def as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (k, s, ...) with the version each sees: newest of its key with seq <= s.

    Versions and probes share one order by key; no range join, no pairs.
    """
    extra = [c for c in probes.columns if c not in ("k", "s")]
    a = log.select("k", F.col("seq").alias("s"), F.lit(0).alias("_probe"), F.struct("seq", "op", "v").alias("_version"))
    b = probes.withColumn("_probe", F.lit(1))
    seen = F.last("_version", ignorenulls=True).over(Window.partitionBy("k").orderBy("s", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("seen", seen).where("_probe = 1")
    put = F.col("seen.op") == PUT
    return rows.select("k", "s", *extra, F.when(put, F.col("seen.seq")).alias("seen_seq"), F.when(put, F.col("seen.v")).alias("seen_v"))


def layered(layers: Sequence[DataFrame]) -> DataFrame:
    """Newest layer wins: layers of resolved (k, op, v), newest first; live keys only."""
    tagged: list[DataFrame] = [x.select("k", "op", "v", F.lit(-i).alias("seq")) for i, x in enumerate(layers)]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    return live(out)


def sort_key(kind: str, k: Column) -> Column:
    """A column that orders, and equates, keys as a comparator does.

    bytewise: as they are. reverse: by their bytes from the last. numeric: by the number
    written as ``[10]`` or ``[0xa]``.
    """
    if kind == "bytewise":
        return k
    if kind == "reverse":
        return F.reverse(k.cast("string"))
    if kind == "numeric":
        inner = F.regexp_extract(k.cast("string"), r"^\[(.*)\]$", 1)
        return F.when(inner.startswith("0x"), F.conv(F.substring(inner, 3, 64), 16, 10)).otherwise(inner).cast("long")
    raise ValueError(f"no comparator {kind!r}")

"""A versioned key-value table in a folder: immutable sorted runs and a manifest.

Runs are Parquet folders, sorted by (key, newest first), with Bloom filters on the key. A
commit writes new runs, then a manifest that names all live runs, then moves the pointer
file CURRENT to it; a reader sees one commit or the other. Reads are DataFrames over the
runs that a key range can touch. One writer holds the lock.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import compact as compaction
from ..operators import ordered, reads, stats
from ..operators.batches import SLOW_FILES, STOP_FILES, Batch, check_ops, group_writers, number
from ..operators.resolve import live, merge_runs, resolve
from ..schema import DELETE, LEVELS, LOG, PUT, Corruption, InvalidArgument
from .files import Folder

COMPARATOR = "bytewise"
#: Bytes of entries that an output of a compaction has, about.
OUTPUT_BYTES = 128 << 20
#: Sizes among which each file's Bloom filter takes the least that its keys fill: 1 MiB, and halves of that down to 32 bytes.
BLOOM_SIZES = 16
#: Seconds for which a lock holds after its owner's last commit.
LEASE = 3600.0


def _facts() -> tuple:
    return (F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.max("seq").alias("s"), F.sum(stats.encoded_size(F.col("k"), F.col("v"))).alias("size"))


class KVTable:
    """Open with ``KVTable.open``; use as a context manager to release the lock."""

    def __init__(self, spark: SparkSession, path: str, options: dict):
        self.spark, self.folder, self.options = spark, Folder(spark, path), options
        self.error: Exception | None = None
        self.owner = uuid.uuid4().hex
        self.history: list[dict] = []

    # --- opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, create_if_missing: bool = False, error_if_exists: bool = False, comparator: str = COMPARATOR, compression: str = "zstd", bloom: bool = True, paranoid: bool = False, output_bytes: int = OUTPUT_BYTES, lease: float = LEASE) -> "KVTable":
        """Open for writing. The lock has an owner and ends ``lease`` seconds after its last commit, so a writer that died doesn't hold it for ever."""
        table = cls(spark, path, {"comparator": comparator, "compression": compression, "bloom": bloom, "paranoid": paranoid, "output_bytes": output_bytes, "lease": lease})
        found = table.folder.exists("CURRENT")
        if not found and not create_if_missing:
            raise InvalidArgument(f"{path}: no table here, and none was to be made")
        if found and error_if_exists:
            raise InvalidArgument(f"{path}: there is a table already")
        table.folder.make()
        table._lock()
        try:
            if found:
                table._recover()
            else:
                table.state = {"version": 0, "last_seq": 0, "next_file": 1, "comparator": comparator, "files": [], "snapshots": {}}
                table._commit()
        except Exception:
            table.close()
            raise
        return table

    def _lock(self) -> None:
        text = f"{self.owner} {time.time() + self.options['lease']}"
        try:
            self.folder.create("LOCK", text)
        except Exception as e:
            holder = (self.folder.read("LOCK") if self.folder.exists("LOCK") else "").split()
            if len(holder) == 2 and float(holder[1]) >= time.time():
                raise InvalidArgument(f"{self.folder.path}: another writer holds the lock") from e
            self.folder.replace("LOCK", text)
        if not self._holds_lock():  # of two that break an old lock the last one has it
            raise InvalidArgument(f"{self.folder.path}: another writer took the lock")

    def _holds_lock(self) -> bool:
        return self.folder.exists("LOCK") and self.folder.read("LOCK").split()[:1] == [self.owner]

    def _check_lock(self) -> None:
        if not self._holds_lock():
            raise InvalidArgument(f"{self.folder.path}: the lock has gone to another writer")

    def _recover(self) -> None:
        """Newest manifest, its runs all present, runs it doesn't name removed."""
        self.state = json.loads(self.folder.read(self.folder.read("CURRENT").strip()))
        for field in ("last_seq", "next_file", "comparator"):
            if field not in self.state:
                raise Corruption(f"manifest without {field}")
        if self.state["comparator"] != self.options["comparator"]:
            raise InvalidArgument(f"comparator {self.options['comparator']} doesn't match {self.state['comparator']}")
        there = self._runs_there()
        missing = [f["name"] for f in self.state["files"] if f["name"] not in there]
        if missing:
            raise Corruption(f"{len(missing)} missing runs, e.g. {missing[0]}")
        self.collect_garbage()

    def close(self) -> None:
        if self._holds_lock():
            self.folder.delete("LOCK")

    def __enter__(self) -> "KVTable":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Delete what belongs to a table; a missing folder is fine, other files stay."""
        folder = Folder(spark, path)
        for name in folder.names():
            if name in ("CURRENT", "LOCK", "runs") or name.startswith("MANIFEST-") or name.endswith(".dbtmp"):
                folder.delete(name)
        if folder.exists() and not folder.names():
            folder.delete()

    @staticmethod
    def repair(spark: SparkSession, path: str, comparator: str = COMPARATOR) -> "KVTable":
        """A table from the runs that are there, where the manifest is lost: all at level 0, deletes included."""
        table = KVTable(spark, path, {"comparator": comparator, "compression": "zstd", "bloom": True, "paranoid": False, "output_bytes": OUTPUT_BYTES, "lease": LEASE})
        table._lock()
        table.state = {"version": max([int(n.split("-")[1]) for n in table.folder.names() if n.startswith("MANIFEST-") and n[9:].isdigit()], default=0), "last_seq": 0, "next_file": 1, "comparator": comparator, "files": [], "snapshots": {}}
        for name in sorted(table._runs_there()):
            n = int(name.split(".")[0])
            if "/" in name:  # an output of a job that made several: numbers start anew
                n = table.state["next_file"]
            if run := table._describe(n, name, 0):
                table.state["files"].append(run)
                table.state["last_seq"] = max(table.state["last_seq"], run["max_seq"])
            table.state["next_file"] = max(table.state["next_file"], n + 1)
        table._commit()
        return table

    # --- commits

    def _commit(self, sync: bool = False) -> None:
        self._check_lock()
        self.folder.create("LOCK", f"{self.owner} {time.time() + self.options['lease']}", replace=True)
        self.state["version"] += 1
        name = f"MANIFEST-{self.state['version']:06d}"
        self.folder.create(name, json.dumps(self.state), replace=True, sync=sync)
        self.folder.replace("CURRENT", name)

    def _guard(self, work):
        """Run a write; the first failure stays and fails all later writes, reads go on."""
        if self.error:
            raise self.error
        self._check_lock()
        try:
            return work()
        except (InvalidArgument, Corruption):
            raise
        except Exception as e:
            self.error = e
            raise

    def _writer(self, rows: DataFrame) -> DataFrameWriter:
        """Without a size that fits its keys a filter has 1 MiB in every file, however small."""
        writer = rows.write.option("compression", self.options["compression"])
        if self.options["bloom"]:
            writer = writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#k", BLOOM_SIZES)
        return writer

    def _write_run(self, rows: DataFrame, level: int, read: int = 0) -> dict | None:
        """A sorted run of rows (k, seq, op, v), made of ``read`` bytes of other runs; None if there are none."""
        n = self.state["next_file"]
        self.state["next_file"] += 1
        name = f"{n:06d}.run"
        path = f"{self.folder.path}/runs/{name}"
        began = time.time()
        self._writer(rows.repartitionByRange("k").sortWithinPartitions("k", F.desc("seq"), F.desc("op"))).parquet(path)
        run = self._describe(n, name, level)
        if run is None:
            self.folder.delete(f"runs/{name}")
        else:
            self.history.append({"level": level, "seconds": time.time() - began, "read": read, "written": run["file_size"]})
        return run

    def _runs_there(self) -> set[str]:
        """Names of the runs in the folder; a job of several outputs has a folder of its own."""
        out = set()
        for name in self.folder.names("runs"):
            parts = [n for n in self.folder.names(f"runs/{name}") if n.startswith("out=")]
            out |= {f"{name}/{n}" for n in parts} or {name}
        return out

    def _write_runs(self, rows: DataFrame, level: int, read: int, most: int, least: int = 1) -> list[dict]:
        """Sorted runs of rows in ranges of keys, of about ``most`` bytes and at least about ``least`` of them; no key is in two.

        They are cut by the bytes of the rows that are left. The ``read`` bytes they are made
        of count only for as many outputs as there are tasks to merge them.
        """
        if read <= most and least <= 1:
            run = self._write_run(rows, level, read)
            return [run] if run else []
        n = self.state["next_file"]
        job, began = f"{n:06d}.run", time.time()
        path = f"{self.folder.path}/runs/{job}"
        kept = ordered.dealt(rows.withColumn("_size", stats.encoded_size(F.col("k"), F.col("v"))), ["k"])
        try:
            size = kept.agg(F.sum("_size")).first()[0] or 0
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            outputs = max(1, -(-size // most), least, min(-(-read // most), tasks))
            parts = ordered.cut(kept, "k", "_size", max(1, -(-size // outputs)), "out").drop("_size").repartition(min(outputs, tasks), "out")
            self._writer(parts.sortWithinPartitions("out", "k", F.desc("seq"), F.desc("op"))).partitionBy("out").parquet(path)
        finally:
            kept.unpersist()
        found = self.spark.read.schema(T.StructType([*LOG.fields, T.StructField("out", T.IntegerType())])).parquet(path).groupBy("out").agg(*_facts()).orderBy("out").collect()  # a row for each output
        runs = [self._entry(s, n + i, f"{job}/out={s['out']}", level) for i, s in enumerate(found)]
        self.state["next_file"] = n + max(1, len(runs))
        self.history.append({"level": level, "seconds": time.time() - began, "read": read, "written": sum(r["file_size"] for r in runs)})
        return runs

    def _entry(self, s, n: int, name: str, level: int) -> dict:
        return {"level": level, "file_no": n, "name": name, "entries": s["n"], "file_size": s["size"], "stored": self.folder.size(f"runs/{name}"), "smallest": bytes(s["a"]).hex(), "largest": bytes(s["b"]).hex(), "max_seq": s["s"]}

    def _describe(self, n: int, name: str, level: int) -> dict | None:
        """A run's entry for the manifest, from its rows; None if it has none."""
        s = self.spark.read.schema(LOG).parquet(f"{self.folder.path}/runs/{name}").agg(*_facts()).first()
        return self._entry(s, n, name, level) if s["n"] else None

    def files(self) -> DataFrame:
        """The manifest's runs, keys as binary."""
        rows = [(f["level"], f["file_no"], f["file_size"], f["entries"], bytearray.fromhex(f["smallest"]), bytearray.fromhex(f["largest"])) for f in self.state["files"]]
        return self.spark.createDataFrame(rows, "level long, file_no long, file_size long, entries long, smallest binary, largest binary")

    def _scan(self, files: list[dict]) -> DataFrame:
        paths = [f"{self.folder.path}/runs/{f['name']}" for f in files]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All entries of runs that [low, high] can touch."""
        meets = lambda f: (high is None or f["smallest"] <= high.hex()) and (low is None or f["largest"] >= low.hex())  # noqa: E731  hex keeps the order
        return self._scan([f for f in self.state["files"] if meets(f)])

    # --- writes

    def put(self, k: bytes, v: bytes, sync: bool = False) -> int:
        return self.write(Batch().put(k, v), sync)

    def delete(self, k: bytes, sync: bool = False) -> int:
        return self.write(Batch().delete(k), sync)

    def _admit(self) -> None:
        """Hold a writer back while too many level-0 runs wait for compaction."""
        level0 = lambda: sum(f["level"] == 0 for f in self.state["files"])
        if level0() >= SLOW_FILES:
            time.sleep(0.001)
        while level0() >= STOP_FILES and self.maintain():
            pass

    def write(self, batch: Batch | DataFrame, sync: bool = False, stream_batch: int | None = None) -> int:
        """Apply a batch, or rows (batch_id, pos, op, k, v), as one commit; the last sequence.

        ``sync``: the manifest is forced to storage before this returns. ``stream_batch``
        is remembered with the rows, or alone if there are none.
        """

        def work() -> int:
            self._admit()
            base, held = self.state["last_seq"] + 1, []
            if isinstance(batch, Batch):
                if not batch.ops:
                    return self.state["last_seq"]
                check_ops(batch.ops)
                rows = batch.rows(self.spark, base)
            else:
                bad = batch.where(~F.coalesce(F.col("op").isin(DELETE, PUT) & F.col("k").isNotNull() & (F.col("v").isNull() == (F.col("op") == DELETE)), F.lit(False)))
                if bad.limit(1).count():
                    raise Corruption("rows that are neither a put with a value nor a delete without one")
                rows = number(batch, base, held).select(F.col("k").cast("binary").alias("k"), "seq", F.col("op").cast("byte").alias("op"), F.col("v").cast("binary").alias("v"))
            try:
                run = self._write_run(rows, 0)
            finally:
                for kept in held:
                    kept.unpersist()
            if run:
                level = compaction.flush_level(self.files(), self.spark.createDataFrame([(0, bytearray.fromhex(run["smallest"]), bytearray.fromhex(run["largest"]))], "run_id long, smallest binary, largest binary")).first()["level"] if self.state["files"] else 2
                run["level"] = level
                self.state["files"].append(run)
                self.state["last_seq"] = max(self.state["last_seq"], run["max_seq"])
            if stream_batch is not None:
                self.state["stream_batch"] = stream_batch
            if run or stream_batch is not None:
                self._commit(sync)
            return self.state["last_seq"]

        return self._guard(work)

    def write_all(self, writers: list[tuple[Batch, bool]]) -> list[int]:
        """Batches of waiting writers (batch, sync), in order: one commit for each group a leader takes along.

        Returns the last sequence of each writer's batch.
        """
        out: list[int] = []
        for group in group_writers((b.size(), sync) for b, sync in writers):
            at, together = self.state["last_seq"], Batch()
            for i in group:
                together.append(writers[i][0])
                out.append(at + len(together))
            self.write(together, any(writers[i][1] for i in group))
        return out

    # --- snapshots

    def snapshot(self) -> str:
        """A handle that pins reads, and compaction, to the last sequence."""
        handle = uuid.uuid4().hex
        self.state["snapshots"][handle] = self.state["last_seq"]
        self._commit()
        return handle

    def release(self, handle: str) -> None:
        self.state["snapshots"].pop(handle)
        self._commit()

    def oldest(self) -> int:
        return min(self.state["snapshots"].values(), default=self.state["last_seq"])

    def _at(self, snapshot: str | int | None) -> int:
        s = self.state["snapshots"][snapshot] if isinstance(snapshot, str) else self.state["last_seq"] if snapshot is None else snapshot
        if s < self.state.get("compacted_to", 0):
            raise InvalidArgument(f"sequence {s} is older than what compaction has kept")
        return s

    # --- reads

    def get(self, k: bytes, snapshot: str | int | None = None) -> bytes | None:
        """The value, or None if there is no live entry (an empty value is b'')."""
        row = reads.get(self.log(k, k), bytearray(k), self._at(snapshot)).first()
        return bytes(row["v"]) if row else None

    def get_many(self, requests: DataFrame, snapshot: str | int | None = None) -> DataFrame:
        return reads.three_state(self.log(), requests, self._at(snapshot))

    def scan(self, low: bytes | None = None, high: bytes | None = None, prefix: bytes | None = None, after: bytes | None = None, snapshot: str | int | None = None, reverse: bool = False) -> DataFrame:
        """Live (k, v) in order of the key."""
        if prefix is not None:
            low, high = max(prefix, low or b""), min(filter(None, (reads.prefix_end(prefix), high)), default=None)
        b = lambda x: None if x is None else bytearray(x)
        rows = reads.scan(self.log(low, high), b(low), b(high), None, b(after), self._at(snapshot))
        return rows.select("k", "v").orderBy(F.desc("k") if reverse else F.asc("k"))

    def versions(self) -> DataFrame:
        """All entries kept, tombstones included, newest first in each key."""
        return self.log().orderBy("k", F.desc("seq"), F.desc("op"))

    # --- maintenance

    def compact(self, begin: bytes | None = None, end: bytes | None = None) -> None:
        """Merge the runs that meet [begin, end], level by level, to the deepest they reach."""

        def meets(f: dict) -> bool:
            return (end is None or f["smallest"] <= end.hex()) and (begin is None or f["largest"] >= begin.hex())

        deepest = max((f["level"] for f in self.state["files"] if meets(f)), default=0)
        for level in range(max(1, deepest)):
            self._guard(lambda level=level: self._merge(level, meets))
        self._guard(lambda: self._settle(max(1, deepest), meets))

    def _merge(self, level: int, meets) -> None:
        files = self.state["files"]
        inputs = [f for f in files if f["level"] == level and meets(f)]
        if not inputs:
            return
        touching = lambda at, of: [f for f in files if f["level"] == at and f["smallest"] <= max(x["largest"] for x in of) and f["largest"] >= min(x["smallest"] for x in of)]

        def closed(some: list[dict]) -> list[dict]:
            """Level 0 overlaps: all its runs that the range reaches, to a fixed point. Deeper levels don't."""
            while level == 0 and len(grown := touching(0, some)) > len(some):
                some = grown
            return some

        inputs = closed(inputs)
        lower = touching(level + 1, inputs)
        if lower:  # more of the upper level, where that takes no more of the lower one
            more = closed(touching(level, inputs + lower))
            if len(touching(level + 1, more)) == len(lower):
                inputs = more
        upper = inputs
        inputs = inputs + lower
        low, high = min(f["smallest"] for f in inputs), max(f["largest"] for f in inputs)
        taken = {f["file_no"] for f in inputs}
        deeper = [f for f in files if f["level"] >= level + 2]
        below = sum(f["file_size"] for f in deeper if f["level"] == level + 2 and f["smallest"] <= high and f["largest"] >= low)
        if compaction.is_trivial_move(len(inputs), sum(f["level"] == level + 1 for f in inputs), below):
            inputs[0]["level"] = level + 1
            self.state.setdefault("pointers", {})[str(level)] = upper[0]["largest"]
            self._commit()
            return
        ranges = self.spark.createDataFrame([(bytearray.fromhex(f["smallest"]), bytearray.fromhex(f["largest"])) for f in deeper], "smallest binary, largest binary") if deeper else None
        oldest = self.oldest()
        size, most = sum(f["file_size"] for f in inputs), self.options["output_bytes"]
        # an output has about ``most`` bytes, and overlaps about as much of the level below as one may
        runs = self._write_runs(compaction.compact(self._scan(inputs), oldest, ranges), level + 1, size, most, -(-below // (compaction.GRANDPARENT_OUTPUTS * most)))
        self.state.setdefault("pointers", {})[str(level)] = max(f["largest"] for f in upper)
        self._replace(taken, runs, oldest)

    def _settle(self, level: int, meets) -> None:
        """Rewrite in their level the runs that came down without a merge, or were merged for an older snapshot: they may hold hidden entries."""
        oldest = self.oldest()
        inputs = [f for f in self.state["files"] if f["level"] == level and meets(f) and f.get("merged_at", -1) < min(oldest, f["max_seq"])]
        if not inputs:
            return
        taken = {f["file_no"] for f in inputs}
        deeper = [(bytearray.fromhex(f["smallest"]), bytearray.fromhex(f["largest"])) for f in self.state["files"] if f["level"] > level]
        ranges = self.spark.createDataFrame(deeper, "smallest binary, largest binary") if deeper else None
        runs = self._write_runs(compaction.compact(self._scan(inputs), oldest, ranges), level, sum(f["file_size"] for f in inputs), self.options["output_bytes"])
        self._replace(taken, runs, oldest)

    def _replace(self, taken: set[int], runs: list[dict], oldest: int) -> None:
        """Commit runs merged for snapshots from ``oldest`` on in place of those taken."""
        for run in runs:
            run["merged_at"] = oldest
        self.state["files"] = [f for f in self.state["files"] if f["file_no"] not in taken] + runs
        self.state["compacted_to"] = max(self.state.get("compacted_to", 0), oldest)
        self._commit()
        self.collect_garbage()

    def maintain(self) -> bool:
        """One compaction if a level is due."""
        if not self.state["files"]:
            return False
        pointers = [(int(n), bytearray.fromhex(k)) for n, k in self.state.get("pointers", {}).items()]
        chosen = compaction.candidate(self.files(), self.spark.createDataFrame(pointers, "level long, pointer binary")).first()
        if chosen is None:
            return False
        self._guard(lambda: self._merge(chosen["level"], lambda f: f["file_no"] == chosen["file_no"]))
        return True

    def collect_garbage(self) -> list[str]:
        """Remove runs and manifests that the current manifest doesn't need; their names."""
        live_runs = {f["name"] for f in self.state["files"]}
        gone = [f"runs/{n}" for n in self._runs_there() if n not in live_runs]
        jobs = {n.split("/")[0] for n in live_runs}
        gone += [f"runs/{n}" for n in self.folder.names("runs") if n not in jobs and f"runs/{n}" not in gone]
        current = self.folder.read("CURRENT").strip()
        gone += [n for n in self.folder.names() if (n.startswith("MANIFEST-") and n != current) or n.endswith(".dbtmp")]
        for name in gone:
            self.folder.delete(name)
        return gone

    # --- introspection

    def property(self, name: str):
        """Value of a property as text, or None if there is none of that name."""
        if name == stats.PREFIX + "stats":
            return self._stats()
        return stats.property_of(self.spark, self.files(), name)

    def _stats(self) -> str:
        """A line for each level in use: files, MB, and the seconds, MB read and MB written of its jobs."""
        out = ["level files mb seconds read_mb written_mb"]
        for level in range(LEVELS):
            files = [f["file_size"] for f in self.state["files"] if f["level"] == level]
            jobs = [h for h in self.history if h["level"] == level]
            if files or jobs:
                total = {k: sum(h[k] for h in jobs) for k in ("seconds", "read", "written")}
                out.append(f"{level} {len(files)} {sum(files) / 1e6:.1f} {total['seconds']:.1f} {total['read'] / 1e6:.1f} {total['written'] / 1e6:.1f}")
        return "\n".join(out)

    def cache(self) -> DataFrame:
        """Keep the newest live entries in memory and on disk; ``unpersist`` the result to let go."""
        return live(self.log(), self._at(None)).persist()

    def approximate_sizes(self, ranges: list[tuple[bytes, bytes]]) -> list[int]:
        """Bytes of entries in each half-open range, in the runs it touches."""
        low, high = min(a for a, _ in ranges), max(b for _, b in ranges)
        rows = stats.approximate_sizes(self.log(low, high), [(bytearray(a), bytearray(b)) for a, b in ranges]).collect()
        return [r["bytes"] for r in rows]

    def view(self, name: str, snapshot: str | int | None = None) -> None:
        """Register the live entries for SQL."""
        live(self.log(), self._at(snapshot)).select("k", "v").createOrReplaceTempView(name)

    def newest(self) -> DataFrame:
        return resolve(merge_runs([self.log()]))

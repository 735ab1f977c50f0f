"""Processing only what is new or changed: current content against known content, and a ledger of work items.

A work item is one content of one file. It is *pending* until a worker takes it; *leased* while that worker's lease runs;
*done* when the worker has committed it. A lease that expires returns its items to pending. Every lease carries a fencing
token, larger than all before it. A commit counts only if no larger token had leased the item before it, which is judged
when states are folded from the events, not when the commit is written: so no check can be overtaken between looking and
writing. Leases and commits are files at paths that depend on the token and the items only, written once; a repeated
attempt finds its own file and adds nothing. States are never stored, so no crash can leave them half changed.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.session import settle


def plain_path(path: Column) -> Column:
    """The shortest plain form of a path: no empty or `.` segments, `..` resolved, no slash at the end.

    `..` at the start of a relative path stays; at the root it is dropped. Null stays null; a path that names nothing but
    its own folder is `.`, or `/` if absolute. Only paths that need it are taken apart.
    """
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when((s == "") | (s == "."), done)
            .when((s == "..") & up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((s == "..") & path.startswith("/"), done)
            .otherwise(F.array_append(done, s))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    resolved = F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))
    return F.when(path.rlike(r"(^|/)(\.\.?)?(/|$)"), resolved).otherwise(path)


def plain_hash(value: Column) -> Column:
    """64 lower-case hexadecimal digits of a SHA-256 value in any usual spelling; null for anything else."""
    found = F.regexp_extract(F.lower(F.trim(value)), r"^(?:sha-?256[:=])?\s*([0-9a-f]{64})$", 1)
    return F.nullif(found, F.lit(""))


def current_content(scans: DataFrame) -> DataFrame:
    """(filepath, hash): the content of each file that exists, by its latest scan.

    scans: (scan_id, filepath, hash, outcome, seen_at, loaded_at). Rows whose outcome is `error`, without path, or `ok`
    without a hash say nothing; a file whose latest row is `gone` has no content. Equal times are decided by loaded_at,
    then scan_id; a missing time is the earliest. One path may hold any share of the rows: they are reduced before they
    are shuffled.
    """
    rows = scans.select(plain_path(F.col("filepath")).alias("filepath"), plain_hash(F.col("hash")).alias("hash"), "outcome", "seen_at", "loaded_at", "scan_id")
    rows = rows.where("filepath is not null and (outcome = 'gone' or (outcome = 'ok' and hash is not null))")
    last = F.max(F.struct("seen_at", "loaded_at", "scan_id", "outcome", "hash")).alias("last")
    latest = rows.groupBy("filepath").agg(last)
    return latest.where("last.outcome = 'ok'").select("filepath", F.col("last.hash").alias("hash"))


def known_content(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """(filepath, hash, token): what the last successful run that wrote a file knew of it; token is its run_id.

    Rows of runs that did not end well, or without a valid hash or path, say nothing. Within a run the later row counts.
    runs is broadcast only if it is below Spark's threshold.
    """
    good = runs.where("status = 'ok'").select("run_id").distinct()
    rows = ledger.join(good, "run_id", "left_semi").select(
        plain_path(F.col("filepath")).alias("filepath"), plain_hash(F.col("hash")).alias("hash"), "run_id", "written_at"
    )
    rows = rows.where("filepath is not null and hash is not null")
    latest = rows.groupBy("filepath").agg(F.max(F.struct("run_id", "written_at", "hash")).alias("last"))
    return latest.select("filepath", F.col("last.hash").alias("hash"), F.col("last.run_id").alias("token"))


ITEMS = "filepath string, hash string, offered_at timestamp"
EVENTS = "filepath string, hash string, token bigint, kind string, at timestamp, expires_at timestamp"


def fold(items: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(filepath, hash, state, token): the state of the last offered item of each path.

    events: (filepath, hash, token, kind, at, expires_at); kind is `lease`, `done`, or `known` for a commit of a history
    that was accepted long ago. A `done` counts unless a larger token leased the item before it (or at a time unknown).
    Of the commits of one path that count the one under the largest token tells what is known of it: an item is done if
    that is its content, so a file that went back to an older content is pending again. Otherwise it is leased while the
    lease under the largest token runs. token is that of the running lease, else of the path's known commit. Events are
    reduced to one for each item, token and kind before they are shuffled; a path of any share of them makes no hot task.
    """
    every = events.where("filepath is not null and hash is not null and token is not null")
    reduced = every.groupBy("filepath", "hash", "token", "kind").agg(F.max("at").alias("at"), F.min("at").alias("first"), F.max("expires_at").alias("expires_at"))
    larger = Window.partitionBy("filepath", "hash").orderBy(F.col("token").desc()).rangeBetween(Window.unboundedPreceding, -1)
    # -1 in descending order: the tokens that are larger by one at least.
    fenced = F.min(F.when(F.col("kind") == "lease", F.coalesce("first", F.lit("0001-01-01").cast("timestamp")))).over(larger)
    judged = reduced.withColumn("fenced", fenced)
    good = (F.col("kind") == "known") | ((F.col("kind") == "done") & (F.col("fenced").isNull() | (F.col("fenced") > F.col("at"))))
    known = judged.where(good).groupBy("filepath").agg(F.max(F.struct("token", "at", "hash")).alias("k"))
    leases = judged.where("kind = 'lease'").groupBy("filepath", "hash").agg(F.max(F.struct("token", "expires_at")).alias("l"))
    last = items.where("filepath is not null and hash is not null").groupBy("filepath").agg(F.max(F.struct("offered_at", "hash")).alias("i"))
    last = last.select("filepath", F.col("i.hash").alias("hash"))
    both = last.join(known, "filepath", "left").join(leases, ["filepath", "hash"], "left")
    state = F.when(F.col("k.hash") == F.col("hash"), "done").when(F.col("l.expires_at") > now, "leased").otherwise("pending")
    return both.select("filepath", "hash", state.alias("state"), F.when(state == "leased", F.col("l.token")).otherwise(F.col("k.token")).alias("token"))


def known_events(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """What past runs that ended well wrote, as events: known, under the run_id as token. Within a run the later row of a
    path counts."""
    none = F.lit(None).cast("timestamp")
    return known_content(ledger, runs).select("filepath", "hash", "token", F.lit("known").alias("kind"), none.alias("at"), none.alias("expires_at"))


def history(ledger: DataFrame, runs: DataFrame, lease_seconds: float) -> DataFrame:
    """The events of the log of past runs: known_events, and what a run that is still marked as running wrote is leased by it
    from its start on, for lease_seconds. Runs that failed hold nothing."""
    running = runs.where("status = 'running'").select("run_id", "started_at").distinct()
    held = ledger.join(running, "run_id").select(
        plain_path(F.col("filepath")).alias("filepath"), plain_hash(F.col("hash")).alias("hash"), F.col("run_id").alias("token"), F.lit("lease").alias("kind"),
        F.col("started_at").alias("at"), (F.col("started_at") + F.make_dt_interval(secs=F.lit(float(lease_seconds)))).alias("expires_at"),
    )
    return known_events(ledger, runs).unionByName(held)


def work_items(scans: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """(filepath, hash, state, token): each existing file's current content, `done` if the last successful run that wrote
    the file knew that content, else `pending`. The time is that at which no lease of a past run is left."""
    items = current_content(scans).withColumn("offered_at", F.lit(None).cast("timestamp"))
    return fold(items, known_events(ledger, runs), F.lit("9999-01-01").cast("timestamp"))


class WorkLedger:
    """A ledger of work items under a folder that all workers share.

    add() offers items, lease() takes pending ones, commit() ends them, states() tells the state at a time. All take the
    time as an argument, so that runs can be repeated; tokens come from exclusive creation of a file, so no two leases
    share one. Times must come from one clock, or from clocks that agree to within less than a lease.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _read(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def _write_once(self, df: DataFrame, path: str) -> None:
        """df at path; nothing if it is there already, over the remains of an attempt that didn't end."""
        if not self._exists(f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)

    def add(self, items: DataFrame, batch: str, now: dt.datetime | None = None) -> None:
        """Offer (filepath, hash) items; a repeated batch adds nothing, a repeated item counts once. Of a path that is offered
        with several contents the one offered last counts; without a time, the largest hash."""
        rows = items.select("filepath", "hash").where("filepath is not null and hash is not null").distinct()
        self._write_once(rows.withColumn("offered_at", F.lit(now).cast("timestamp")), f"{self.folder}/items/batch={batch}")

    def record(self, events: DataFrame, name: str) -> None:
        """Take over events (EVENTS) of another log; a repeated name adds nothing. New tokens are larger than theirs."""
        self._write_once(events, f"{self.folder}/events/history={name}")
        top = self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events/history={name}").agg(F.max("token").alias("t")).head()["t"]
        self._fs.mkdirs(self._path(f"{self.folder}/tokens"))
        if top is not None:
            self._fs.createNewFile(self._path(f"{self.folder}/tokens/{top}"))

    def _token(self) -> int:
        self._fs.mkdirs(self._path(f"{self.folder}/tokens"))
        taken = [int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.folder}/tokens")) if s.getPath().getName().isdigit()]
        token = max(taken, default=0) + 1
        while not self._fs.createNewFile(self._path(f"{self.folder}/tokens/{token}")):
            token += 1
        return token

    def states(self, now: dt.datetime) -> DataFrame:
        """(filepath, hash, state, token) of the last offered item of every path at a time; see fold()."""
        return fold(self._read("items", ITEMS), self._read("events", EVENTS), F.lit(now).cast("timestamp"))

    def lease(self, now: dt.datetime, seconds: float, most: int | None = None) -> tuple[int, DataFrame]:
        """Take all pending items, or the first `most` by path: (token, items). Of two workers that lease at the same
        time both may see an item as pending; the larger token holds it, and the other's later commit doesn't count."""
        token = self._token()
        items = self.states(now).where("state = 'pending'").select("filepath", "hash")
        if most is not None:
            items = items.orderBy("filepath", "hash").limit(most)
        path = f"{self.folder}/events/token={token}/lease"
        self._write_once(self._event(items, token, "lease", now, now + dt.timedelta(seconds=seconds)), path)
        return token, self.leased(token)

    def leased(self, token: int) -> DataFrame:
        """The items that a lease took, as written: the same whenever they are read, whatever has been committed since."""
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events/token={token}/lease").select("filepath", "hash")

    @staticmethod
    def _event(items: DataFrame, token: int, kind: str, at: dt.datetime, expires: dt.datetime | None) -> DataFrame:
        return items.select(
            "filepath", "hash", F.lit(token).cast("bigint").alias("token"), F.lit(kind).alias("kind"), F.lit(at).cast("timestamp").alias("at"),
            F.lit(expires).cast("timestamp").alias("expires_at"),
        )

    def commit(self, token: int, items: DataFrame, now: dt.datetime) -> DataFrame:
        """End items under a token, all at once or in portions: (filepath, hash, accepted). Written are those that the token
        leased, at a path that depends on the token and these items: another portion has its own path, a repeated commit
        finds its file. Accepted are those whose commit counts by fold(): an expired lease that nobody took over is still
        the holder's. One that another lease overtakes in this very moment may be done twice, with the same result at the
        same output_path()."""
        mine = settle(items.select("filepath", "hash").join(self.leased(token), ["filepath", "hash"], "left_semi").distinct())
        key = mine.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(filepath, hash))").alias("x"), F.expr("bit_xor(xxhash64(hash, filepath, 1))").alias("y")).head()
        if key["n"]:
            name = hashlib.sha256(f"{key['n']}:{key['x']}:{key['y']}".encode()).hexdigest()[:32]
            self._write_once(self._event(mine, token, "done", now, None), f"{self.folder}/events/token={token}/done={name}")
        after = self.states(now).where("state = 'done'").select("filepath", "hash", "token")
        asked = items.select("filepath", "hash").distinct()
        return asked.join(after, ["filepath", "hash"], "left").select("filepath", "hash", F.coalesce(F.col("token") == token, F.lit(False)).alias("accepted"))

    def output_path(self, item: str) -> str:
        """Where a worker writes the result of an item: it depends on the item alone, so a retry overwrites it."""
        return f"{self.folder}/results/{hashlib.sha256(item.encode()).hexdigest()}"


#: Seconds of a lease of a run.
LEASE_SECONDS = 6 * 3600.0


def next_run(spark: SparkSession, folder: str, scans: DataFrame, ledger: DataFrame, runs: DataFrame, lease_seconds: float = LEASE_SECONDS) -> tuple[WorkLedger, int, DataFrame, dt.datetime]:
    """(work ledger, token, leased items, time): what the next run takes. The log of past runs becomes events, the files'
    current content is offered, and a lease takes what is pending once the leases of runs that are still marked as running
    have expired: what such a run didn't finish is taken over under a larger token."""
    work = WorkLedger(spark, folder)
    last = runs.agg(F.max(F.greatest("started_at", F.coalesce("finished_at", "started_at"))).alias("t")).head()["t"] or dt.datetime(1970, 1, 1)
    work.record(history(ledger, runs, lease_seconds), "runs")
    work.add(current_content(scans), "scan", last)
    now = last + dt.timedelta(seconds=lease_seconds)
    token, items = work.lease(now, lease_seconds)
    return work, token, items, now

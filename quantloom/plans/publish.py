"""Immutable generations, commit markers, summaries: all through Hadoop's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.driver import check_key, stable_hash
from ..operators.merge import fingerprint, fingerprints, keep_last, upsert, upsert_keep_last
from ..schemas import check_physical, conform, dataset


class Files:
    """Small JSON files and path tests on whatever file system the root lies on.

    A file appears whole or not at all: it is written under another name in the
    same folder, then renamed.  Without ``overwrite`` the rename fails if the
    name is taken, so of several writers one wins.  That holds on HDFS and on
    local disks (there a hard link takes the name); on a store without such a
    rename two writers at once are not told apart.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm

    def _at(self, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{check_key(key)}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, key: str) -> bool:
        path, fs = self._at(key)
        return fs.exists(path)

    def names(self, key: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        path, fs = self._at(key)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _rename(self, fs, source, target, overwrite: bool) -> bool:
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        if not overwrite and fs.getUri().getScheme() == "file":
            nio = self._jvm.java.nio.file
            link = lambda p: nio.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
            try:
                nio.Files.createLink(link(target), link(source))
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        kind = self.spark.sparkContext._gateway.new_array(options, 1)
        kind[0] = options.OVERWRITE if overwrite else options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, kind)
        except Exception as e:
            if not overwrite and "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def write(self, key: str, value: dict, overwrite: bool) -> bool:
        """Write a JSON file; without ``overwrite`` only if there is none.  Whether it was written."""
        path, fs = self._at(key)
        if not overwrite and fs.exists(path):
            return False
        folder, _, name = key.rpartition("/")
        draft, _ = self._at(f"{folder + '/' if folder else ''}.{name}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        finally:
            out.close()
        try:
            return self._rename(fs, draft, path, overwrite)
        finally:
            fs.delete(draft, False)

    def read(self, key: str) -> dict | None:
        path, fs = self._at(key)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def move(self, key: str, target: str) -> None:
        """Give a folder another name; the target must not exist."""
        path, fs = self._at(key)
        to, _ = self._at(target)
        fs.mkdirs(to.getParent())
        if not fs.rename(path, to):
            raise OSError(f"{target}: the folder could not be moved")

    def delete(self, key: str) -> None:
        path, fs = self._at(key)
        fs.delete(path, True)


class Conflict(RuntimeError):
    """A generation or commit exists with other contents."""


class Publisher:
    """Content-addressed generations of a dataset; a commit marker, written last, is the only way to one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def _base(self, name: str) -> str:
        return f"processed/{name}"

    def _generation(self, name: str, date: str, generation: str, mode: str | None) -> str:
        middle = f"rebalance_mode={mode}/" if mode else ""
        return f"{self._base(name)}/trade_date={date}/{middle}generation={generation}"

    def _commit(self, name: str, date: str, mode: str | None) -> str:
        return f"commits/{name}/{f'{mode}-' if mode else ''}{date}.json"

    def _id(self, name: str, date: str, mode: str | None, inputs: dict, checksum: str) -> str:
        return stable_hash({"dataset": name, "date": date, "mode": mode, "inputs": inputs, "checksum": checksum})

    def _stored(self, name: str, keys: dict[str, str], base: str | None = None) -> DataFrame:
        """Rows of generations, one for each date, with the dataset's columns; the date is read off the path."""
        root = f"{self.files.root}/{base or self._base(name)}"
        found = self.spark.read.option("basePath", root).parquet(*[f"{self.files.root}/{k}" for k in keys.values()])
        out = found.withColumn("trade_date", F.date_format("trade_date", "yyyy-MM-dd") if dict(found.dtypes)["trade_date"] == "date" else F.col("trade_date").cast("string")).select(*dataset(name).names)
        check_physical(out, name)
        return out

    def publish_dates(self, df: DataFrame, name: str, dates: list[str], inputs: dict, mode: str | None = None, create_only: bool = True) -> dict[str, dict]:
        """Publish every date of ``dates``: one job writes them beside, one reads them back for the checksums that name the generations.

        Then each folder is moved to its place, and the commits follow, one
        small file for each date.  A stored generation
        that is not what its name says is written again unless a commit points
        to it.  Returns the commits that count, by date.
        """
        rows = conform(df, name).where(F.col("trade_date").isin(dates))
        # what is checked and kept are the very rows that were written: a frame worked out twice may differ in a last digit
        stage = f"staging/{uuid.uuid4().hex}"
        rows.repartition("trade_date").write.partitionBy("trade_date").parquet(f"{self.files.root}/{stage}")
        try:
            staged = {n.partition("=")[2]: f"{stage}/{n}" for n in self.files.names(stage) if n.startswith("trade_date=")}
            empty = fingerprint(self.spark.createDataFrame([], rows.schema))
            sums = {d: empty for d in dates} | (fingerprints(self._stored(name, staged, stage), "trade_date") if staged else {})
            ids = {d: self._id(name, d, mode, inputs, sums[d][1]) for d in dates}
            keys = {d: self._generation(name, d, ids[d], mode) for d in dates}
            there = {d: keys[d] for d in staged if self.files.exists(keys[d])}
            known = fingerprints(self._stored(name, there), "trade_date") if there else {}
            for d in there:
                if known.get(d) == sums[d]:
                    continue
                commit = self.commit_of(name, d, mode)
                if commit and commit["key"] == keys[d]:
                    raise Conflict(f"{name} {d}: the stored generation differs from what was written")
                self.files.delete(keys[d])
            moved = [d for d in staged if not self.files.exists(keys[d])]
            for d in moved:
                self.files.move(staged[d], keys[d])
        finally:
            self.files.delete(stage)
        return {d: self._mark(name, d, mode, {"dataset": name, "trade_date": d, "mode": mode, "generation": ids[d], "key": keys[d], "rows": sums[d][0], "checksum": sums[d][1], "inputs": inputs}, create_only) for d in dates}

    def _mark(self, name: str, date: str, mode: str | None, commit: dict, create_only: bool) -> dict:
        if self.files.write(self._commit(name, date, mode), commit, overwrite=not create_only):
            return commit
        winner = self.files.read(self._commit(name, date, mode))
        if winner["checksum"] != commit["checksum"] or winner["inputs"] != commit["inputs"]:
            raise Conflict(f"{name} {date}: a commit with other contents exists")
        return winner

    def publish(self, df: DataFrame, name: str, date: str, inputs: dict, mode: str | None = None, create_only: bool = True) -> dict:
        """``publish_dates`` of one date."""
        return self.publish_dates(df, name, [date], inputs, mode, create_only)[date]

    def commit_of(self, name: str, date: str, mode: str | None = None) -> dict | None:
        return self.files.read(self._commit(name, date, mode))

    def committed(self, name: str, mode: str | None = None) -> list[str]:
        """Dates that have a commit."""
        head = f"{mode}-" if mode else ""
        return [n[len(head) : -5] for n in self.files.names(f"commits/{name}") if n.startswith(head) and n.endswith(".json") and len(n) == len(head) + 15]

    def read(self, name: str, date: str, mode: str | None = None, run_id: str | None = None) -> DataFrame:
        """The committed generation, after its commit, schema, rows and checksum are verified; ``run_id``: the run it must come from."""
        return self.read_dates(name, [date], mode, run_id)

    def read_dates(self, name: str, dates: list[str], mode: str | None = None, run_id: str | None = None) -> DataFrame:
        """Committed generations of several dates, verified in one job; a selection is also worked out again from its rows."""
        commits = {}
        for d in dates:
            commit = commits[d] = self.commit_of(name, d, mode)
            if commit is None:
                raise FileNotFoundError(f"{name} {d}: no commit")
            want = self._generation(name, d, commit["generation"], mode)
            named = commit["dataset"] == name and commit["trade_date"] == d and commit["mode"] == mode and commit["key"] == want
            if not named or commit["generation"] != self._id(name, d, mode, commit["inputs"], commit["checksum"]):
                raise Conflict(f"{name} {d}: the commit does not describe its generation")
            if run_id is not None and commit["inputs"].get("run_id") != run_id:
                raise Conflict(f"{name} {d}: the commit is of another run")
        filled = {d: c["key"] for d, c in commits.items() if c["rows"]}
        if not filled:
            return self.spark.createDataFrame([], dataset(name).schema)
        df = self._stored(name, filled)
        sums = fingerprints(df, "trade_date")
        for d in filled:
            if sums.get(d) != (commits[d]["rows"], commits[d]["checksum"]):
                raise Conflict(f"{name} {d}: the generation was changed")
        if name == "selection_result":
            from ..operators import quality

            quality.validate(df, name)
            weights = commits[dates[0]]["inputs"].get("weights")
            if weights and any(quality.recomputation_faults(df, weights).first()):
                raise Conflict(f"{name}: scores, levels or texts do not follow from the rows")
        return df


class PointerTable:
    """A Parquet table in versions: new files are written first, the pointer to them last.

    ``by``: a column whose values have files of their own; a merge then writes
    only the values that come in.  Files that neither the pointer nor the one
    before it names are deleted, so a reader that has just begun can finish.
    """

    def __init__(self, spark: SparkSession, root: str, by: str | None = None):
        self.spark, self.files, self.by = spark, Files(spark, root), by

    def _now(self) -> dict:
        return self.files.read("current.json") or {"version": None, "parts": {}, "before": {}}

    def read(self, schema, only: list[str] | None = None) -> DataFrame:
        parts = {k: v for k, v in self._now()["parts"].items() if only is None or k in only}
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{p}" for p in sorted(set(parts.values()))])

    def _move(self, version: str, parts: dict[str, str]) -> None:
        now = self._now()
        self.files.write("current.json", {"version": version, "parts": parts, "before": now["parts"]}, overwrite=True)
        named = {p.split("/")[1] for p in (*parts.values(), *now["parts"].values())}
        for folder in self.files.names("data"):
            if folder not in named:
                self.files.delete(f"data/{folder}")

    def replace(self, df: DataFrame, version: str) -> None:
        """The whole table anew; nothing happens if it stands at the version."""
        if self._now()["version"] == version:
            return
        folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.files.root}/{folder}")
        self._move(version, {"": folder})

    def merge(self, rows: DataFrame, keys: list[str], order: list[str], version: str) -> None:
        """Upsert by key, the last row of each key by ``order``; only the incoming values of ``by`` are read and written."""
        now = self._now()
        if now["version"] == version:
            return
        if self.by is None:
            return self.replace(upsert_keep_last(self.read(rows.schema), rows, keys, order), version)
        if self.by not in keys:
            raise ValueError("the column that parts the files must be one of the keys")
        values = [r[0] for r in rows.select(F.col(self.by).cast("string")).distinct().collect()]  # of one batch
        if not values:
            return
        merged = upsert_keep_last(self.read(rows.schema, values), rows, keys, order)
        folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("__part", F.sha2(F.col(self.by).cast("string"), 256)).repartition("__part").write.partitionBy("__part").parquet(f"{self.files.root}/{folder}")
        parts = {v: f"{folder}/__part={stable_text(v)}" for v in values}
        self._move(version, now["parts"] | parts)

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        merged = upsert(self.read(rows.schema), rows, keys)
        self.replace(merged, stable_hash([str(fingerprint(rows)), self._now()])[:24])


def stable_text(value: str) -> str:
    import hashlib

    return hashlib.sha256(value.encode()).hexdigest()


class AtomicWriter:
    """Objects written under a temporary name, checked, then under their own; the temporary one goes."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def put(self, key: str, data: bytes) -> int:
        """Write an object whole; its size is checked before and after it takes its name.  Returns the size."""
        path, fs = self.files._at(key)
        draft, _ = self.files._at(f"tmp/{uuid.uuid4().hex}")
        try:
            out = fs.create(draft, True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
            if fs.getFileStatus(draft).getLen() != len(data):
                raise OSError(f"{key}: {fs.getFileStatus(draft).getLen()} of {len(data)} bytes were written")
            fs.mkdirs(path.getParent())
            self.files._rename(fs, draft, path, True)
            size = fs.getFileStatus(path).getLen()
            if size != len(data):
                raise OSError(f"{key}: {size} of {len(data)} bytes arrived")
            return size
        finally:
            fs.delete(draft, False)


def land_raw(spark: SparkSession, root: str, rows: DataFrame, name: str, request: dict, evidence: dict) -> str:
    """Raw provider rows under a key made of request, response and evidence; written once, read back, compared.  Returns the key."""
    response = fingerprint(rows)
    key = f"landing/{check_key(name)}/request={stable_hash(request)[:32]}/response={response[1][:32]}/evidence={stable_hash(evidence)[:32]}"
    files = Files(spark, root)
    if not files.exists(f"{key}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(f"{files.root}/{key}")
    back = spark.read.schema(rows.schema).parquet(f"{files.root}/{key}")
    if fingerprint(back) != response:
        raise Conflict(f"{key}: the landed rows differ from the response")
    files.write(f"{key}.json", {"request": request, "evidence": evidence, "rows": response[0], "checksum": response[1]}, overwrite=False)
    return key


def write_sorted(df: DataFrame, keys: list[str], path: str) -> None:
    """Rows in the order of their keys, over all files: what a canonical partition looks like."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def newest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the newest row of each key, as the snapshot migration does."""
    return keep_last(rows, keys, order)


def manifest(df: DataFrame) -> dict:
    """Rows, checksum and date span of a frame, for a run's manifest."""
    count, checksum = fingerprint(df)
    span = df.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).first() if "trade_date" in df.columns else {"a": None, "b": None}
    return {"rows": count, "checksum": checksum, "first_date": span["a"], "last_date": span["b"]}

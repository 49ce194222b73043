"""Published datasets that are merged when read: a base, runs of updates, and a log of commits.

A batch of submissions is reduced to one row a key and written as a run; what is
written does not grow with the dataset.  Reading joins the base with the runs,
reduced again to one row a key.  Runs whose rows come to more than half of the
base's are folded into a new base, so that every row is rewritten a bounded
number of times.  Base and runs are dealt to folders by a hash of the key: the
rows of given keys are read from their folders alone.

A commit is a small file that names base, runs, and the last batch of every
writer; it is put in place by a rename that fails where a file of that number
exists.  Whoever comes second reads the new state and tries the next number: a
run says what to add, not what it found, so publishing is never done over.
What replaces the rows that its writer has read does conflict.  A batch that is
no later than its writer's last changes nothing.  A reader keeps the files that
its commit names; ``clean`` removes what no kept commit names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .publish import ADD, CONCATENATE, FieldMap, Link, append, incoming, merged

BUCKET = "__bucket"


class Conflict(Exception):
    """The dataset has changed since its writer read it."""


@dataclass(frozen=True)
class Commit:
    version: int
    base: str
    schema: str  # of the base, as JSON
    base_rows: int
    runs: list[dict] = field(default_factory=list)  # path, rows, schema, fields (none: whole rows, appended)
    seen: dict[str, int] = field(default_factory=dict)  # writer: its last batch

    @property
    def run_rows(self) -> int:
        return sum(r["rows"] for r in self.runs)


class PublishedDataset:
    def __init__(self, spark: SparkSession, path: str, key: str, initial: DataFrame | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if initial is not None and not self.versions():
            self._put(self._base(0, initial))

    # ---- the log

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        log = self._at("log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit(self, version: int | None = None) -> Commit:
        """The commit of that number, or the last."""
        number = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._at(f"log/{number:020}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Commit(**json.loads(text))

    def _put(self, c: Commit) -> bool:
        """Whether the commit is now the one of its number."""
        draft, place = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{c.version:020}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(c)).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, place, kinds)
        except Exception as e:
            if self._fs.exists(place):
                self._fs.delete(draft, False)
                return False
            raise e
        return True

    # ---- data

    def _write(self, df: DataFrame, key: str, what: str) -> tuple[str, int]:
        """Folder and rows of df, dealt by the key's hash."""
        name = f"data/{what}-{uuid.uuid4().hex[:12]}"
        dealt = df.withColumn(BUCKET, self._bucket(F.col(key)))
        dealt.repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return name, self._read(name, df.schema).count()

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields]).add(BUCKET, IntegerType())).parquet(f"{self.path}/{name}")

    def _base(self, version: int, rows: DataFrame, **more) -> Commit:
        name, n = self._write(rows, self.key, "base")
        return Commit(version, name, rows.schema.json(), n, **more)

    def read(self, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """The dataset as of a commit; with ``keys``, these keys' rows, from their folders alone."""
        return self._folded(self.commit(version), keys)

    def _folded(self, c: Commit, keys: list[str] | None = None) -> DataFrame:
        def some(df: DataFrame, key: str) -> DataFrame:
            if keys is not None:
                hashed = self.spark.createDataFrame([(str(k),) for k in keys], "k string").select(self._bucket(F.col("k"))).distinct()
                df = df.where(F.col(BUCKET).isin([r[0] for r in hashed.collect()]) & F.col(key).cast("string").isin([str(k) for k in keys]))
            return df.drop(BUCKET)

        of = lambda schema: StructType.fromJson(json.loads(schema))
        rows = some(self._read(c.base, of(c.schema)), self.key)
        at = 0
        while at < len(c.runs):
            same = [r for r in c.runs[at:]]
            same = same[: next((k for k, r in enumerate(same) if r["fields"] != same[0]["fields"]), len(same))]
            kept = [some(self._read(r["path"], of(r["schema"])), "__key" if r["fields"] is not None else self.key) for r in same]
            if same[0]["fields"] is None:
                for more in kept:
                    rows = append(rows, more)
            else:
                fields = [FieldMap(**f) for f in same[0]["fields"]]
                parts = None
                for k, df in enumerate(kept):
                    df = df.withColumn("__run", F.lit(k))
                    parts = df if parts is None else parts.unionByName(df)
                rows = merged(rows, _reduced(parts, fields) if len(kept) > 1 else parts.drop("__run"), Link("", self.key, fields))
            at += len(same)
        return rows

    # ---- writers

    def publish(self, submissions: DataFrame, link: Link, order: list[str], writer: str = "", batch: int | None = None) -> Commit:
        """Submissions published; a writer's batches count once each, in ascending order."""
        c = self.commit()
        if not link.enabled or (batch is not None and batch <= c.seen.get(writer, -1)):
            return c
        parts = incoming(submissions, link, order)
        name, n = self._write(parts, "__key", "run")
        run = {"path": name, "rows": n, "schema": parts.schema.json(), "fields": [asdict(f) for f in link.fields]}
        return self._add(run, writer, batch)

    def append(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> Commit:
        """Upload in append mode: whole rows."""
        name, n = self._write(rows, self.key, "rows")
        return self._add({"path": name, "rows": n, "schema": rows.schema.json(), "fields": None}, writer, batch)

    def _add(self, run: dict, writer: str, batch: int | None) -> Commit:
        while True:
            c = self.commit()
            if batch is not None and batch <= c.seen.get(writer, -1):
                return c
            seen = c.seen if batch is None else {**c.seen, writer: batch}
            new = replace(c, version=c.version + 1, runs=[*c.runs, run], seen=seen)
            if self._put(new):
                return self.compact() if new.run_rows > new.base_rows / 2 and len(new.runs) > 1 else new

    def replace(self, rows: DataFrame, read_version: int) -> Commit:
        """Rows in place of those that the writer read; a conflict if there are others by now."""
        if self.commit().version != read_version:
            raise Conflict(f"version {self.commit().version} is not {read_version}")
        new = self._base(read_version + 1, rows, seen=self.commit(read_version).seen)
        if not self._put(new):
            raise Conflict(f"version {new.version} is another writer's")
        return new

    def compact(self) -> Commit:
        """The runs folded into a new base. Runs that arrive meanwhile stay runs; if another base does, it stands."""
        c = self.commit()
        folded = self._base(c.version + 1, self._folded(c))
        while True:
            now = self.commit()
            if now.base != c.base:
                return now
            new = replace(folded, version=now.version + 1, runs=now.runs[len(c.runs) :], seen=now.seen)
            if self._put(new):
                return new

    def clean(self, keep: int = 10) -> None:
        """Removes all but the last commits, and the data that none of those names. Not for use while others publish."""
        versions = self.versions()
        kept = [self.commit(v) for v in versions[-keep:]]
        named = {name for c in kept for name in (c.base, *(r["path"] for r in c.runs))}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"log/{v:020}.json"), False)
        for s in self._fs.listStatus(self._at("data")):
            if f"data/{s.getPath().getName()}" not in named:
                self._fs.delete(s.getPath(), True)


def _reduced(parts: DataFrame, fields: list[FieldMap]) -> DataFrame:
    """Several runs' parts as one row a key, in the order of the runs."""
    out = []
    for k, f in enumerate(fields):
        v = F.col(f"__{k}")
        if f.update == ADD:
            one = F.sum(v)
        elif f.update == CONCATENATE:
            held = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("__run", v.alias("v")))))
            held = F.reverse(held) if f.position == "BEGINNING" else held
            one = F.nullif(F.array_join(F.transform(held, lambda x: x["v"]), f.separator), F.lit(""))
        else:
            one = F.max_by(v, F.when(v.isNotNull(), F.col("__run")))
        out.append(one.alias(f"__{k}"))
    return parts.groupBy("__key").agg(*out)

"""The lexicon store: tables made of runs of Parquet files, with one small state that names them all.

A table is a set of runs.  Replacing a language's or a lexicon's rows writes a
run and drops the old ones of that part; nothing else is touched.  Counts are
appended: a batch writes a run as large as itself, reading adds the runs up, and
runs of one size are merged once there are several, so every row is rewritten a
few times however long a stream goes on.  The index of spellings is bucketed by
spelling: a join on it doesn't shuffle it, and a few spellings read few files.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.statistics import accumulated
from lexispark.schemas import LANGUAGE_ROWS, LANGUAGES, TABLES

#: What tells rows of an accumulated table apart, and what is added up.
COUNTED = {
    "morph_frequencies": (["language_code", "feature_key"], "count"),
    "prior_frequencies": (["language_code", "previous_feature_key", "current_feature_key"], "count"),
    "document_frequencies": (["document_id", "lemma_id"], "weighted_frequency"),
}
#: Columns by which a table's rows lie in ranges, so that files can be passed over by what their footers say.
RANGED = {"senses": ["lemma"], "entries": ["key"], **{name: keys for name, (keys, _) in COUNTED.items()}}
#: The table that is bucketed, and by what.
BUCKETED = {"spellings": "value"}
#: So many runs of one level and part are merged into one of the next.
FAN_IN = 8
VERSION = 4
PART = "_part"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir (one of its own on a local master without one)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lexispark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of the tables that the innermost block of temporary() has written.
_TEMPORARY: list[list[str]] = []


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written in the block leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def checkpointed(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder; one to keep outlives a block of temporary()."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if _TEMPORARY and not keep:
        _TEMPORARY[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are checkpointed in the block are deleted at its end: what came of them has been written by then."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            forgotten(spark, path)


def forgotten(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """checkpointed(df), and aggregates of its rows, told by the job that writes it."""
    told = Observation(f"counters-{uuid.uuid4().hex}")
    held = checkpointed(df.observe(told, *(c.alias(name) for name, c in counters.items())))
    return held, told.get


def replaced(old: DataFrame, new: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """old with the rows of the given values of a column exchanged for new."""
    return old.where(~F.col(column).isin(*values)).unionByName(new)


@dataclass(frozen=True)
class Change:
    """Rows that come to a table, and the parts whose rows go: all of them, those named, or none."""

    rows: DataFrame | None = None
    gone: Sequence[str] | None = None
    buckets: int = 8


class Store:
    """A folder of the store's tables, for one writer at a time.

    Every write goes beside what is there.  A state of the store is a small file
    that names the runs of each table, and the last batch of each stream that
    went into them; it appears by one rename, so several tables change at once or
    not at all.  The state before stays readable.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder of the store."""
        fs, at = self._at(f"{self.path}/{path}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())

    def _states(self) -> list[int]:
        fs, at = self._at(f"{self.path}/_states")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def _state(self, number: int) -> dict:
        fs, at = self._at(f"{self.path}/_states/{number}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict:
        numbers = self._states()
        return self._state(numbers[-1]) if numbers else {"version": VERSION, "tables": {}, "streams": {}}

    def exists(self, name: str) -> bool:
        return bool(self.state()["tables"].get(name))

    def runs(self, name: str, parts: Sequence[str] | None = None) -> list[dict]:
        return [r for r in self.state()["tables"].get(name, []) if parts is None or r["part"] in parts]

    def read(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """A table's rows (of some parts), counts of all runs added up."""
        return self._rows(name, self.runs(name, parts))

    def _rows(self, name: str, runs: Sequence[dict]) -> DataFrame:
        schema, _ = TABLES[name]
        out = self.spark.createDataFrame([], schema)
        by_fill: dict[str, list[dict]] = {}
        for r in runs:
            by_fill.setdefault(json.dumps(r.get("fill") or {}), []).append(r)
        tables = []
        for fill, some in by_fill.items():
            if name in BUCKETED:
                tables += [self._bucketed(r) for r in some]
                continue
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{r['path']}" for r in some))
            tables.append(rows.withColumns({c: F.lit(v) for c, v in json.loads(fill).items()}).select(*schema.names))
        if tables:
            out = tables[0]
            for t in tables[1:]:
                out = out.unionByName(t)
        if name in COUNTED and len(runs) > len({r["part"] for r in runs}):
            keys, count = COUNTED[name]
            out = accumulated(out, keys, [c for c in schema.names if c not in {*keys, count}], count).select(*schema.names)
        return out

    def _bucketed(self, run: dict) -> DataFrame:
        """A run as a bucketed table, which every session has to be told of once."""
        name, schema = run["table"], TABLES["spellings"][0]
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (value) SORTED BY (value) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{run['path']}'")
        return self.spark.table(name)

    def spellings(self, language: str, values: Sequence[str] | None = None) -> DataFrame:
        """The index of a language's spellings; of the given few, their buckets alone are read."""
        rows = self.read("spellings", [language])
        return rows if values is None else rows.where(F.col("value").isin(*values))

    def _written(self, name: str, rows: DataFrame, level: int = 0, buckets: int = 8) -> list[dict]:
        """Rows as runs, one for each part."""
        with cleaned(self.spark):
            return self._runs_of(name, rows, level, buckets)

    def _runs_of(self, name: str, rows: DataFrame, level: int, buckets: int) -> list[dict]:
        schema, part = TABLES[name]
        columns = [F.col(f.name).cast(f.dataType) for f in schema.fields]
        path = f"{name}-{uuid.uuid4().hex}"
        if name in BUCKETED:
            # Rows are dealt as buckets are, so a task writes one file of its own.
            table, by = f"lexispark_{uuid.uuid4().hex}", BUCKETED[name]
            parts = [r[part] for r in rows.select(part).distinct().collect()]  # languages
            if len(parts) > 1:
                return [run for p in parts for run in self._runs_of(name, rows.where(F.col(part) == p), level, buckets)]
            rows.select(*columns).repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet").option("compression", "zstd").option("path", f"{self.path}/{path}").saveAsTable(table)
            return [{"path": path, "part": p, "level": level, "table": table, "buckets": buckets} for p in parts]
        rows = rows.select(*columns, *([F.col(part).alias(PART)] if part else []))
        if name in RANGED:
            keys = [*([PART] if part else []), *RANGED[name]]
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        if not part:
            rows.write.option("compression", "zstd").parquet(f"{self.path}/{path}")
            return [{"path": path, "part": None, "level": level}]
        rows.write.option("compression", "zstd").partitionBy(PART).parquet(f"{self.path}/{path}")
        return [{"path": f"{path}/{f}", "part": unquote(f.split("=", 1)[1]), "level": level} for f in self.folders(path) if f.startswith(f"{PART}=")]

    def commit(self, changes: Mapping[str, DataFrame | Change], batch: tuple[str, int] | None = None) -> None:
        """Change tables, and note a stream's batch, all at once; a DataFrame stands for all of a table's rows."""
        state = self.state()
        for name, change in changes.items():
            change = change if isinstance(change, Change) else Change(change)
            kept = [] if change.gone is None else [r for r in state["tables"].get(name, []) if r["part"] not in change.gone]
            state["tables"][name] = kept + (self._written(name, change.rows, buckets=change.buckets) if change.rows is not None else [])
        if batch is not None:
            state["streams"][batch[0]] = batch[1]
        self.switch(state)

    def switch(self, state: dict) -> None:
        """Make a state the store's."""
        numbers = self._states()
        fs, aside = self._at(f"{self.path}/_states/_{uuid.uuid4().hex}")
        stream = fs.create(aside)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(aside, self._at(f"{self.path}/_states/{numbers[-1] + 1 if numbers else 1}")[1]):
            raise OSError(f"the state of the store at {self.path} can't be switched")
        self._tidy(numbers, state)

    def _tidy(self, numbers: list[int], state: dict) -> None:
        """Delete states before the last one's predecessor, and runs that neither of the two names."""
        last = self._state(numbers[-1]) if numbers else {"tables": {}}
        known = {path for s in (state, last) for runs in s["tables"].values() for path in _paths(runs)}
        for number in numbers[:-1]:
            for runs in self._state(number)["tables"].values():
                for path in _paths(runs) - known:
                    if any(k.startswith(f"{path}/") for k in known):
                        continue  # a run of today lies in a folder of the first version
                    fs, at = self._at(f"{self.path}/{path}")
                    fs.delete(at, True)
                for r in runs if isinstance(runs, list) else ():
                    if "table" in r and r["path"] not in known:
                        self.spark.sql(f"DROP TABLE IF EXISTS {r['table']}")
            fs, at = self._at(f"{self.path}/_states/{number}")
            fs.delete(at, False)

    def write(self, name: str, rows: DataFrame) -> None:
        self.commit({name: rows})

    def replace(self, name: str, rows: DataFrame, column: str, values: Sequence[str]) -> None:
        """Exchange the rows of some languages or lexica (parts of the table) for others."""
        if column != TABLES[name][1]:
            raise ValueError(f"{name} isn't kept by {column}")
        self.commit({name: Change(rows, values)})

    def without_language(self, language: str) -> dict[str, Change]:
        """A language's lemmas go, and with them their parses, spellings and document frequencies; statistics stay."""
        return {name: Change(gone=[language]) for name in ("lemmas", "parses", "spellings", "document_frequencies")}

    def delete_language(self, language: str) -> None:
        self.commit(self.without_language(language))

    def clear_lexicon(self, lexicon: str) -> None:
        self.commit({name: Change(gone=[lexicon]) for name in ("senses", "entries")})

    def noted(self, batch: tuple[str, int] | None) -> bool:
        """Whether a stream's batch is in the store already."""
        return batch is not None and self.state()["streams"].get(batch[0], -1) >= batch[1]

    def accumulate(self, counts: Mapping[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Add counts to the stored ones, all tables at once; doing so twice counts twice, but for a noted batch."""
        if self.noted(batch):
            return
        self.commit({name: Change(rows, ()) for name, rows in counts.items()}, batch)
        for name in counts:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Merge runs of a level and part where there are fan_in of them, from the lowest level on."""
        state, before = self.state(), None
        while before != (before := json.dumps(state["tables"].get(name, []))):
            groups: dict[tuple, list[dict]] = {}
            for r in state["tables"].get(name, []):
                groups.setdefault((r["level"], r["part"]), []).append(r)
            for (level, part), some in sorted(groups.items(), key=lambda x: (x[0][0], str(x[0][1]))):
                if len(some) >= self.fan_in:
                    rows = self._rows(name, some)
                    rows = rows.withColumn(TABLES[name][1], F.lit(part)) if TABLES[name][1] else rows
                    state["tables"][name] = [r for r in state["tables"][name] if r not in some] + self._written(name, rows, level + 1)
                    break
        if state["tables"].get(name, []) != self.runs(name):
            self.switch(state)

    def languages(self) -> DataFrame:
        return self.spark.createDataFrame(list(LANGUAGES.items()), LANGUAGE_ROWS)


def _paths(runs: list[dict] | str) -> set[str]:
    """Paths of runs; before there were any, of the one folder of a table."""
    return {runs} if isinstance(runs, str) else {r["path"] for r in runs}

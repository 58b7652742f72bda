"""A store of versioned snapshots with compare-and-set, import, export and strict JSON reading.

A snapshot is three tables: records, jobs and embeddings.  Parquet has no compare-and-set, so a commit writes
its tables to folders of its own and then publishes the marker ``_committed/<revision>``, which names them.
The marker appears whole and at most once: by a hard link on local disks, by an atomic rename on HDFS; other
stores need a ``lock`` of the caller.  A writer that loses leaves folders that no marker names.  Readers see
the greatest committed revision.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_LIST = T.ArrayType(T.StringType())

#: The fields of a record.
RECORD_SCHEMA = T.StructType(
    [T.StructField(n, k) for n, k in [
        ("schema_version", T.IntegerType()), ("memory_id", T.StringType()), ("tenant_id", T.StringType()), ("user_id", T.StringType()), ("agent_id", T.StringType()), ("layer", T.StringType()), ("content", T.StringType()), ("status", T.StringType()),
        ("visibility", T.StringType()), ("source_type", T.StringType()), ("confidence", T.DoubleType()), ("occurred_at", T.TimestampType()), ("valid_from", T.TimestampType()), ("valid_until", T.TimestampType()), ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()),
        ("chain_id", T.StringType()), ("revision", T.LongType()), ("supersedes", ID_LIST), ("superseded_by", ID_LIST), ("consolidates", ID_LIST), ("source_memory_ids", ID_LIST), ("source_session_id", T.StringType()),
        ("source_turn_indexes", T.ArrayType(T.LongType())), ("idempotency_key", T.StringType()), ("tags", ID_LIST), ("meta", T.StringType()),
    ]]
)


#: The fields of a write job and of a stored vector.
JOB_SCHEMA = T.StructType(
    [T.StructField(n, k) for n, k in [
        ("job_id", T.StringType()), ("request_id", T.StringType()), ("idempotency_key", T.StringType()), ("raw_memory_id", T.StringType()), ("tenant_id", T.StringType()), ("user_id", T.StringType()), ("agent_id", T.StringType()), ("status", T.StringType()),
        ("started_at", T.TimestampType()), ("finished_at", T.TimestampType()), ("duration_ms", T.LongType()), ("model_calls", T.LongType()), ("code", T.StringType()), ("created_memory_ids", ID_LIST),
    ]]
)
EMBEDDING_SCHEMA = T.StructType([T.StructField("memory_id", T.StringType()), T.StructField("space_id", T.StringType()), T.StructField("dimensions", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType()))])

TABLES = {"records": RECORD_SCHEMA, "jobs": JOB_SCHEMA, "embeddings": EMBEDDING_SCHEMA}


class RevisionConflict(Exception):
    """Another writer committed the revision first, or the expected one is not the latest."""


class InvalidState(Exception):
    """A state that breaks an invariant and is not committed."""


class SnapshotStore:
    """``lock`` is a context manager factory that keeps other writers out, for stores that can't publish a file once."""

    def __init__(self, spark: SparkSession, path: str, lock=None):
        self.spark, self.path, self.lock = spark, path.rstrip("/"), lock

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def revision(self) -> int:
        """The latest committed revision, 0 for an empty store."""
        fs, marks = self._fs(f"{self.path}/_committed")
        names = [s.getPath().getName() for s in fs.listStatus(marks)] if fs.exists(marks) else []
        return max([int(n) for n in names if n.isdigit()], default=0)

    def _folders(self, revision: int) -> dict[str, str]:
        if not revision:
            return {}
        (line,) = self.spark.read.text(f"{self.path}/_committed/{revision}").collect()
        return json.loads(line[0])

    def read(self, revision: int | None = None, table: str = "records") -> DataFrame:
        folder = self._folders(self.revision() if revision is None else revision).get(table)
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], TABLES[table])

    def _publish(self, revision: int, folders: dict[str, str]) -> bool:
        fs, marks = self._fs(f"{self.path}/_committed")
        fs.mkdirs(marks)
        mark, draft = f"{self.path}/_committed/{revision}", f"{self.path}/_committed/.{revision}-{uuid.uuid4().hex}"
        body = json.dumps(folders, sort_keys=True)
        kind = str(fs.getUri().getScheme())
        if kind == "file":
            here = [unquote(urlparse(p).path if "://" in p or p.startswith("file:") else p) for p in (draft, mark)]
            with open(here[0], "w", encoding="utf-8") as out:
                out.write(body)
            try:
                os.link(*here)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(here[0])
        if kind not in ("hdfs", "viewfs") and self.lock is None:
            raise RuntimeError(f"{kind} can't publish a file once; give the store a lock")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        stream = fs.create(self._fs(draft)[1], False)
        stream.write(bytearray(body, "utf-8"))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs(draft)[1], self._fs(mark)[1], options)
            return True
        except Exception:
            if fs.exists(self._fs(mark)[1]):
                fs.delete(self._fs(draft)[1], False)
                return False
            raise

    def commit(self, expected: int, check=None, **tables: DataFrame) -> int:
        """Commit the given tables as the successor of revision ``expected``; the others are carried over.

        ``check(records, jobs, embeddings)`` gives violations (rank, code, memory_id, other_id) of the written state,
        any of which stops the commit.
        """
        with self.lock() if self.lock else contextlib.nullcontext():
            at = self.revision()
            if at != expected:
                raise RevisionConflict(f"expected revision {expected}, found {at}")
            folders = self._folders(at)
            for name, rows in tables.items():
                folder = f"{name}-{expected + 1}-{uuid.uuid4().hex}"
                rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
                folders[name] = folder
            if check is not None:
                state = [self.spark.read.schema(k).parquet(f"{self.path}/{folders[n]}") if n in folders else self.spark.createDataFrame([], k) for n, k in TABLES.items()]
                bad = check(*state).orderBy("rank", "code", "memory_id").limit(1).collect()
                if bad:
                    raise InvalidState(f"{bad[0]['code']} at {bad[0]['memory_id']}")
            if not self._publish(expected + 1, folders):
                raise RevisionConflict(f"revision {expected + 1} was committed by another writer")
            return expected + 1

    def write(self, records: DataFrame, expected: int) -> int:
        """Commit ``records`` as the successor of revision ``expected``."""
        return self.commit(expected, records=records)


def import_outcome(held: DataFrame, incoming: DataFrame, key: str = "memory_id") -> DataFrame:
    """``incoming`` rows with outcome new, same (equal in every column) or conflict against ``held``."""
    shared = [c for c in incoming.columns if c != key and c in held.columns]
    old = held.select(F.col(key), F.struct(*shared).alias("old_row"))
    joined = incoming.join(old, key, "left")
    now = F.struct(*shared)
    outcome = F.when(F.col("old_row").isNull(), "new").when(F.col("old_row").eqNullSafe(now), "same").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("old_row")


def import_faults(incoming: DataFrame, owner=None, layers: list[str] | None = None, embeddings: DataFrame | None = None, space: tuple[str, int] | None = None) -> DataFrame:
    """(memory_id, fault) of rows that may not be imported: of another owner than the condition ``owner``, of a reserved
    layer, or with a vector of another space or width than ``space``."""
    faults = []
    if owner is not None:
        faults.append(incoming.filter(~F.coalesce(owner, F.lit(False))).select("memory_id", F.lit("foreign_owner").alias("fault")))
    if layers is not None:
        faults.append(incoming.filter(~F.coalesce(F.col("layer").isin(layers), F.lit(False))).select("memory_id", F.lit("reserved_layer").alias("fault")))
    if embeddings is not None and space is not None:
        fits = (F.col("space_id") == space[0]) & (F.col("dimensions") == space[1]) & (F.size("vector") == space[1])
        faults.append(embeddings.filter(~F.coalesce(fits, F.lit(False))).join(incoming.select("memory_id"), "memory_id", "left_semi").select("memory_id", F.lit("space_mismatch").alias("fault")))
    out = incoming.select("memory_id", F.lit("").alias("fault")).limit(0)
    for part in faults:
        out = out.unionByName(part)
    return out.distinct()


def import_records(held: DataFrame, incoming: DataFrame, key: str = "memory_id", faults: DataFrame | None = None) -> DataFrame:
    """``held`` with the new rows of ``incoming``, each once; raises ValueError if any row conflicts or is at fault, so all or nothing."""
    incoming = incoming.select(*held.columns).distinct()
    rows = import_outcome(held, incoming, key)
    twice = incoming.groupBy(key).count().filter("count > 1")
    bad = rows.filter("outcome = 'conflict'").select(key).unionByName(twice.select(key)).limit(5).collect()
    if bad:
        raise ValueError(f"import conflicts with held records: {[r[0] for r in bad]}")
    if faults is not None:
        wrong = faults.limit(5).collect()
        if wrong:
            raise ValueError(f"records that may not be imported: {[tuple(r) for r in wrong]}")
    return held.unionByName(rows.filter("outcome = 'new'").select(*held.columns))


def read_json_strict(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """JSON of a fixed schema; any malformed document fails the read."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def export_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def canonical_json(report: DataFrame, *order: str) -> str:
    """A small report as JSON with sorted keys and rows in the given order."""
    rows = [r.asDict(recursive=True) for r in report.orderBy(*order).collect()]
    return json.dumps(rows, sort_keys=True, ensure_ascii=False, default=str)

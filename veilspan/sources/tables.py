"""Reading and writing corpora, gates, requests, reports and the mapping vault."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.model import GATES, GOLD


#: Bytes, as the optimizer knows them, up to which a table is dealt anew.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it is small and has fewer: a
    small file is one split, and detection is work for all of them. Larger tables stay
    as they are read, so no corpus is shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and df.rdd.getNumPartitions() < cores else df


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A
    folder of our own takes its place only where all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="veilspan-")).rstrip("/")


_written: dict[tuple[str, str], str] = {}


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir (our own where that is
    unset), written once for each name in an application. What follows is planned
    from the table, not from the expressions that made it."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if (app, name) not in _written:
        path = f"{shared_base(spark)}/veilspan-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _written[app, name] = path
    return spark.read.schema(df.schema).parquet(_written[app, name])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus in JSON lines; blank lines are passed over. `id` becomes doc_id."""
    return spark.read.schema(GOLD).json(path).where("id is not null").withColumnRenamed("id", "doc_id")


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.select(F.col("doc_id").alias("id"), "template", "language", "text", "entities").write.mode("errorifexists").json(path)


def gates_of(spark: SparkSession, spec: dict) -> tuple[DataFrame, float | None]:
    """(gates a row a label, floor of the total's F1) of a gate file's object."""
    names = ("precision", "recall", "f1", "max_invalid_fp", "min_support")
    rows = []
    for label, g in sorted(spec.get("labels", {}).items()):
        values = [g.get(n) for n in names]
        rows.append((label, *(None if v is None else float(v) for v in values[:3]), *(None if v is None else int(v) for v in values[3:])))
    micro = spec.get("micro_f1")
    return spark.createDataFrame(rows, GATES), None if micro is None else float(micro)


def read_gates(spark: SparkSession, path: str) -> tuple[DataFrame, float | None]:
    """A gate file, one JSON object."""
    text = spark.read.text(path, wholetext=True).first()
    return gates_of(spark, json.loads(text[0]))


def report_json(report: DataFrame, n_docs: int, avg_ms: float, corpus: str | None = None) -> str:
    """The evaluation report as one object; a row a label comes to the driver."""
    fields = ("tp", "fp", "fn", "invalid_fp", "precision", "recall", "f1", "support")
    rows = {r["label"]: {f: r[f] for f in fields} for r in report.collect()}
    out = {"n_docs": n_docs, "avg_ms_per_doc": round(avg_ms, 2), "micro": rows.pop(None, {}), "per_label": dict(sorted(rows.items()))}
    return json.dumps(out | ({"corpus": corpus} if corpus else {}), indent=2, ensure_ascii=False)


def within_size(df: DataFrame, text: str = "text", most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is short enough, the others with a reason)."""
    long = F.coalesce(F.length(text) > most, F.lit(False))
    return df.where(~long), df.where(long).withColumn("reason", F.concat(F.lit("text exceeds "), F.lit(str(most)), F.lit(" characters")))


def response_json(*columns: Column | str) -> Column:
    """A JSON object without its null fields."""
    return F.to_json(F.struct(*columns))


# The vault: mappings of sessions, for a limited time.


def vault_rows(anonymized: DataFrame, now: Column, ttl_seconds: int = 900, mapping: str = "mapping") -> DataFrame:
    """(session_id, mapping, expires_at) for the rows that have a mapping with
    entries. Rows bring their session_id; see `with_session`."""
    kept = anonymized.where(F.col(mapping).isNotNull() & (F.size(mapping) > 0))
    return kept.select("session_id", F.col(mapping).alias("mapping"), (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def with_session(df: DataFrame, mapping: str = "mapping") -> DataFrame:
    """df with a random session_id where the mapping has entries, null elsewhere."""
    return df.withColumn("session_id", F.when(F.size(mapping) > 0, F.replace(F.uuid(), F.lit("-"), F.lit(""))))


def with_mappings(requests: DataFrame, vault: DataFrame, now: Column) -> DataFrame:
    """requests (session_id, mapping, ...) with `known`: the stored mapping, and over
    it the request's own; null if there is neither. Expired sessions are unknown."""
    live = vault.select(F.col("session_id").alias("__session"), F.col("mapping").alias("__stored"), F.col("expires_at").alias("__expires"))
    both = requests.join(live, (F.col("session_id") == F.col("__session")) & (F.col("__expires") > now), "left")
    own, stored = F.col("mapping"), F.col("__stored")
    kept = F.map_filter(stored, lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    merged = F.when(stored.isNull(), own).when(own.isNull(), stored).otherwise(F.map_concat(kept, own))
    return both.withColumn("known", merged).drop("__session", "__stored", "__expires")


def audit(df: DataFrame, spans: str = "spans", *columns: str) -> DataFrame:
    """Counts by label, and nothing of the text."""
    from veilspan.operators.transforms import counts_by_label

    return df.select(*columns, F.size(spans).alias("n_spans"), counts_by_label(F.col(spans)).alias("by_label"))


def log_lines(df: DataFrame, event: str, spans: str = "spans", *columns: str) -> DataFrame:
    """`value`: a JSON object a row with the event's name, the columns and the counts by
    label. Columns are ids and the like; nothing of the text is logged."""
    counts = audit(df, spans, *columns)
    return counts.select(F.to_json(F.struct(F.lit(event).alias("event"), *columns, "n_spans", "by_label")).alias("value"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)

"""The five anti-pattern detectors over operation facts and inferred references.

Operations: req, seq, event_id, op, rk, rv, db, field, obj.  References: src, dst, mandatory.  The entity of an operation
is its database; an operation is tainted by earlier ones of its request on the same object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_delete, is_read, is_write
from ..functions.paths import database_name, schema_name
from ..plans.config import AnalysisConfig
from ..plans.facts import is_primary, is_queue, is_unique
from ..plans.ranking import global_row_number
from .graph import fields_with_prefix


def with_databases(refs: DataFrame) -> DataFrame:
    return refs.withColumns({"src_db": database_name(F.col("src")), "dst_db": database_name(F.col("dst"))})


def written_fields(writes: DataFrame, fields: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Rows of ``writes`` once for each of ``fields`` (field) that their own field is or is above; a write of a whole entity writes all its fields."""
    placed = lambda df, name: df.select(F.col("field").alias(name), database_name(F.col("field")).alias("db"), schema_name(F.col("field")).alias("schema")).distinct()
    below = fields_with_prefix(placed(fields, "path"), placed(writes, "prefix"), config)
    return writes.withColumnRenamed("field", "prefix").join(below, "prefix").drop("prefix").withColumnRenamed("path", "field")


def missing_cascades(ops: DataFrame, refs: DataFrame, ignored: DataFrame | None = None, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Deletes that leave referencing fields in other databases behind: req, seq, event_id, db, pending_db, fields.

    A write of the request to a field, or to a path above it, that optionally references the deleted entity silences this delete and all later ones of the
    request.  A later delete on the same object in a referencing database settles that database, if it has referencing
    fields itself and is not silenced.  ``ignored`` (db, trigger_db or null; entity and
    trigger_entity, if it has them) suppresses pending fields of that entity.
    """
    r = with_databases(refs)
    deletes = ops.where(is_delete(F.col("op"))).select("req", "seq", "event_id", "db", "obj", schema_name(F.col("field")).alias("entity"))
    optional = r.where("NOT mandatory").select(F.col("src").alias("field"), F.col("dst_db").alias("db")).distinct()
    writes = ops.where(is_write(F.col("op"))).select("req", "field").distinct()
    written = written_fields(writes, optional, config).join(optional, "field").select("req", "db").distinct().withColumn("hit", F.lit(1))
    sticky = Window.partitionBy("req").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = deletes.join(written, ["req", "db"], "left").withColumn("silent", F.max(F.coalesce("hit", F.lit(0))).over(sticky)).where("silent = 0").drop("hit", "silent")
    referencing = r.where(~is_queue(F.col("src_db")) & (F.col("src_db") != F.col("dst_db"))).select(F.col("dst_db").alias("db"), F.col("src_db").alias("pending_db"), F.col("src").alias("pending")).distinct()
    live = open_.join(referencing.select("db").distinct(), "db", "left_semi")
    # Whether a database is settled later shows in its last delete; an object has one for each database, however many deletes it sees.
    last = live.groupBy("req", "obj", F.col("db").alias("pending_db")).agg(F.max("seq").alias("last"))
    settled = live.select("req", "obj", "seq", F.col("db").alias("own")).join(last, ["req", "obj"]).where("last > seq AND own <> pending_db").select("req", "seq", "pending_db").distinct()
    pending = live.join(referencing, "db").join(settled, ["req", "seq", "pending_db"], "left_anti")
    if ignored is not None:
        entity = lambda name: F.col(name) if name in ignored.columns else F.lit(None).cast("string")
        i = ignored.select(F.col("db").alias("i_db"), F.col("trigger_db").alias("i_trigger"), entity("entity").alias("i_entity"), entity("trigger_entity").alias("i_trigger_entity"))
        same = (F.col("pending_db") == F.col("i_db")) & (F.col("i_entity").isNull() | (F.col("i_entity") == schema_name(F.col("pending"))))
        trigger = F.col("i_trigger").isNull() | ((F.col("i_trigger") == F.col("db")) & (F.col("i_trigger_entity").isNull() | (F.col("i_trigger_entity") == F.col("entity"))))
        pending = pending.join(i, same & trigger, "left_anti")
    return pending.groupBy("req", "seq", "event_id", "db", "pending_db").agg(F.array_join(F.array_sort(F.collect_set("pending")), ", ").alias("fields"))


def concurrent_writes(ops: DataFrame, refs: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(db, field, n_deletes, n_writes, n_conflicts): writes of fields that optionally reference the entity a delete of another request removes.

    A write of a path above such a field counts as a write of it.
    Conflicts are pairs of requests that differ; they are counted from per-request totals, never listed.
    """
    r = with_databases(refs).where("NOT mandatory").select(F.col("dst_db").alias("db"), F.col("src").alias("field")).distinct()
    deletes = ops.where(is_delete(F.col("op"))).groupBy("req", "db").agg(F.count(F.lit(1)).alias("d"))
    is_conflicting = is_write(F.col("op")) | (F.lit(config.concurrency_includes_upserts) & (F.col("op") == "U"))
    direct = ops.where(is_conflicting).groupBy("req", "field").agg(F.count(F.lit(1)).alias("w"))
    writes = written_fields(direct, r, config).groupBy("req", "field").agg(F.sum("w").alias("w"))
    total_d, total_w = deletes.groupBy("db").agg(F.sum("d").alias("n_deletes")), writes.groupBy("field").agg(F.sum("w").alias("n_writes"))
    own = r.join(deletes, "db").join(writes, ["req", "field"]).groupBy("db", "field").agg(F.sum(F.col("d") * F.col("w")).alias("own"))
    out = r.join(total_d, "db").join(total_w, "field").join(own, ["db", "field"], "left")
    conflicts = F.col("n_deletes") * F.col("n_writes") - F.coalesce("own", F.lit(0))
    return out.select("db", "field", "n_deletes", "n_writes", conflicts.alias("n_conflicts")).where("n_conflicts > 0")


def _hits(ops: DataFrame, refs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(req, event_id, db, field): writes of fields that optionally reference a field of db."""
    r = with_databases(refs).where("NOT mandatory").select(F.col("dst_db").alias("db"), F.col("src").alias("field")).distinct()
    is_conflicting = is_write(F.col("op")) | (F.lit(config.concurrency_includes_upserts) & (F.col("op") == "U"))
    return written_fields(ops.where(is_conflicting).select("req", "event_id", "field"), r, config).join(r, "field").select("req", "event_id", "db", "field")


def dangerous_deletes(ops: DataFrame, refs: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(req, event_id, db, n_writes, fields): each delete that races with writes of other requests, with their number and the distinct fields they
    write, sorted.

    Writes are counted per database, and per field, over all requests and in each one; what other requests write is the difference.  A
    delete meets the counts and the list of fields of its database, never single writes or fields: off the list come those that only its own request writes.
    """
    hits = _hits(ops, refs, config)
    writes = hits.groupBy("req", "event_id", "db").agg(F.count(F.lit(1)).alias("n")).groupBy("req", "db").agg(F.count(F.lit(1)).alias("own"))
    fields = hits.select("req", "db", "field").distinct()
    by_field = fields.groupBy("db", "field").agg(F.count(F.lit(1)).alias("n"), F.min("req").alias("req"))
    alone = by_field.where("n = 1").groupBy("req", "db").agg(F.collect_set("field").alias("alone"))
    of_db = writes.groupBy("db").agg(F.sum("own").alias("total")).join(by_field.groupBy("db").agg(F.array_sort(F.collect_set("field")).alias("listed")), "db")
    deletes = ops.where(is_delete(F.col("op"))).select("req", "event_id", "db").distinct()
    counted = deletes.join(writes, ["req", "db"], "left").join(alone, ["req", "db"], "left").join(of_db, "db").withColumn("n_writes", F.col("total") - F.coalesce("own", F.lit(0))).where("n_writes > 0")
    others = F.when(F.col("alone").isNull(), F.col("listed")).otherwise(F.array_except("listed", "alone"))
    return counted.where(F.size(others) > 0).select("req", "event_id", "db", "n_writes", F.array_join(others, ", ").alias("fields"))


def conflicting_writes(ops: DataFrame, refs: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(req, event_id, db, n_deletes, fields): each write with the number of deletes of other requests it races with, by database, and the fields it hits."""
    grouped = _hits(ops, refs, config).groupBy("req", "event_id", "db").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))
    per_request = ops.where(is_delete(F.col("op"))).groupBy("req", "db").agg(F.count(F.lit(1)).alias("own"))
    totals = per_request.groupBy("db").agg(F.sum("own").alias("total"))
    joined = grouped.join(totals, "db").join(per_request, ["req", "db"], "left").withColumn("n_deletes", F.col("total") - F.coalesce("own", F.lit(0)))
    return joined.where("n_deletes > 0").select("req", "event_id", "db", "n_deletes", "fields")


def read_pairs(ops: DataFrame) -> DataFrame:
    """Reads tainted by an earlier read of the request in another database: op 1 is the later one; each pair of operations once."""
    reads = ops.where(is_read(F.col("op"))).select("req", "obj", "seq", "event_id", "db", "field")
    later = reads.select("req", "obj", F.col("seq").alias("seq1"), F.col("event_id").alias("e1"), F.col("db").alias("db1"), F.col("field").alias("f1"))
    earlier = reads.select("req", "obj", F.col("seq").alias("seq2"), F.col("event_id").alias("e2"), F.col("db").alias("db2"), F.col("field").alias("f2"))
    return later.join(earlier, ["req", "obj"]).where("seq2 < seq1 AND db1 <> db2")


def _known(refs: DataFrame, votes: DataFrame, prefix: str, forward: bool) -> tuple[DataFrame, DataFrame]:
    """References by the two fields of a read pair, and the requests that made them mandatory."""
    a, b = ("f1", "f2") if forward else ("f2", "f1")
    made = votes.where("vote").select(F.col("src").alias(a), F.col("dst").alias(b), "req", F.lit(True).alias(f"{prefix}_own"))
    return refs.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("mandatory").alias(f"{prefix}_mandatory"), F.lit(True).alias(f"{prefix}_exists")), made


def key_coordination(ops: DataFrame, refs: DataFrame, votes: DataFrame, primary: bool, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Uncoordinated reads (req, e1, e2, f1, f2) of references (``primary`` false) or of primary keys.

    A reference that this very request has made mandatory (``votes``: src, dst, req, vote) is no finding.  For primary keys the direction field 1 ->
    field 2, if it exists, is the only one looked at.
    """
    pairs = read_pairs(ops)
    for prefix, forward in (("a", True), ("b", False)):
        known, made = _known(refs, votes, prefix, forward)
        pairs = pairs.join(known, ["f1", "f2"], "left").join(made, ["f1", "f2", "req"], "left")
    both_primary = is_primary(F.col("f1")) & is_primary(F.col("f2"))
    fresh = lambda p: F.coalesce(F.col(f"{p}_mandatory") & F.col(f"{p}_own").isNull(), F.lit(False))
    if primary:
        found = F.when(F.col("a_exists"), fresh("a")).otherwise(fresh("b")) if config.restrictive_pk_coordination else F.lit(True)
        found = both_primary & found
    else:
        found = ~both_primary & ((fresh("a") | fresh("b")) if config.restrictive_fk_coordination else F.lit(True))
    return pairs.where(found).select("req", "e1", "e2", "f1", "f2")


def unique_conflicts(ops: DataFrame) -> DataFrame:
    """(req, event_id, field, n_affected): writes of unique fields, and how many later writes of the request on the same object they taint."""
    writes = ops.where(is_write(F.col("op"))).select("req", "obj", "seq", "event_id", "field")
    later = Window.partitionBy("req", "obj").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    counted = writes.withColumn("n_affected", F.count("event_id").over(later))
    return counted.where(is_unique(F.col("field")) & (F.col("n_affected") > 0)).select("req", "event_id", "field", "n_affected")


def numbered(findings: DataFrame, *order: str) -> DataFrame:
    """Findings with a running number in report order."""
    return global_row_number(findings, "n", *order)

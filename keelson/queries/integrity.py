"""Queries over the facts derived from ``events`` and the star schema, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, order, paths
from ..operators import checks, detectors, graph, references, statements
from ..plans.config import AnalysisConfig
from ..plans.facts import is_primary, operation_facts
from ..plans.ranking import global_row_number
from ..plans.staging import stage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_OPS = """
ops AS (
    SELECT user_id AS req, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id,
           CASE WHEN event_type IN ('click', 'view') THEN 'R' WHEN event_type = 'purchase' THEN 'W' WHEN event_type = 'signup' THEN 'U' WHEN event_type = 'error' THEN 'D' END AS op,
           event_type = 'click' AS rk, event_type = 'view' AS rv, k, 'db' || (k % 6) AS db, 'db' || (k % 6) || '.c.f' || (k % 24) AS field, CAST(floor(value) AS BIGINT) AS obj
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""
_DAY = "user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"
#: The same operations with a user's events of one day as a request.
_DAILY = _OPS.replace("\nops AS", "dops AS").replace("SELECT user_id AS req", f"SELECT {_DAY} AS req").replace("PARTITION BY user_id ", f"PARTITION BY {_DAY} ")
_PAIRS = f"""{_OPS},
pairs AS (
    SELECT a.req, a.obj, a.seq AS seq1, b.seq AS seq2, a.event_id AS e1, b.event_id AS e2, a.op AS op1, b.op AS op2, a.rk AS rk1, b.rk AS rk2,
           a.rv AS rv1, b.rv AS rv2, a.field AS f1, b.field AS f2, a.db AS db1, b.db AS db2
    FROM ops a JOIN ops b ON a.req = b.req AND a.obj = b.obj AND a.seq < b.seq AND a.db <> b.db
)"""
_RULES = f"""{_PAIRS},
ruled AS (
    SELECT *, CASE WHEN op1 IN ('W','U') AND op2 IN ('W','U') THEN 'R1' WHEN op1 = 'R' AND op2 IN ('W','U') THEN 'R2' WHEN op1 IN ('W','U') AND op2 = 'R' THEN 'R3'
                   WHEN op1 = 'R' AND op2 = 'R' AND rk1 AND rk2 THEN 'R4' END AS rule FROM pairs
),
rules AS (
    SELECT *, CASE WHEN rule = 'R3' THEN f1 ELSE f2 END AS src, CASE WHEN rule = 'R3' THEN f2 ELSE f1 END AS dst, NOT (rule = 'R3' AND rv2) AS creates,
           least(f1, f2) AS lo, greatest(f1, f2) AS hi FROM ruled WHERE rule IS NOT NULL
),
nth AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY req, seq2, seq1) AS nth FROM rules WHERE creates),
firsts AS (SELECT * FROM nth WHERE nth = 1)"""
_FK = f"""{_RULES},
voted AS (
    SELECT f.src, f.dst, r.req, CASE WHEN (r.req, r.seq2, r.seq1) = (f.req, f.seq2, f.seq1) THEN r.rule = 'R1'
           WHEN r.rule = 'R1' AND r.op1 = 'W' AND r.op2 = 'W' THEN true WHEN r.rule = 'R2' AND r.op2 = 'W' THEN false WHEN r.rule = 'R3' AND r.op1 = 'W' THEN false END AS vote
    FROM rules r JOIN firsts f ON r.lo = f.lo AND r.hi = f.hi AND (r.req, r.seq2, r.seq1) >= (f.req, f.seq2, f.seq1)
),
votes AS (SELECT src, dst, req, bool_or(vote) AS vote FROM voted WHERE vote IS NOT NULL GROUP BY ALL),
fk AS (SELECT src, dst, bool_and(vote) AS mandatory, count(*) AS n_votes, split_part(src, '.', 1) AS src_db, split_part(dst, '.', 1) AS dst_db FROM votes GROUP BY src, dst)"""
_NUM = "CAST(regexp_extract({0}, 'f([0-9]+)$', 1) AS INT)"


def staged_refs_of(spark: SparkSession, d: str) -> DataFrame:
    """The inferred references, written once: detectors read this small table several times."""
    return stage(refs_of(spark, d), "references")


def staged_ops_of(spark: SparkSession, d: str) -> DataFrame:
    """The operations, numbered by ranges and written once for a query that reads them several times."""
    return stage(operation_facts(table(spark, d, "events"), ranged=True), "operations")


def ops_and_refs_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ops = staged_ops_of(spark, d)
    return ops, stage(references.infer_references(ops), "references")


def daily_ops_and_refs_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Operations by the day, and the references of all operations of a user."""
    return stage(daily_ops_of(spark, d), "daily-operations"), ops_and_refs_of(spark, d)[1]


def ops_refs_votes_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations, references and the votes they come from; the votes of requests stay rows."""
    ops = staged_ops_of(spark, d)
    votes = stage(references.infer_votes(ops), "votes")
    return ops, stage(references.mandatory_references(votes), "references"), votes


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ops_of(spark: SparkSession, d: str) -> DataFrame:
    return operation_facts(table(spark, d, "events"))


def daily_ops_of(spark: SparkSession, d: str) -> DataFrame:
    return operation_facts(table(spark, d, "events"), daily=True)


def rules_of(spark: SparkSession, d: str) -> DataFrame:
    return references.pair_rules(references.operation_pairs(ops_of(spark, d)))


def counted_rules_of(spark: SparkSession, d: str, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Rules with the number of their pairs, which are counted and not listed."""
    return references.pair_rules(references.pair_counts(ops_of(spark, d)), config)


def refs_of(spark: SparkSession, d: str) -> DataFrame:
    return references.infer_references(ops_of(spark, d))


@query("op_counts", f"WITH {_OPS} SELECT op, db, count(*) AS n, count(DISTINCT req) AS n_requests, count(DISTINCT field) AS n_fields FROM ops GROUP BY op, db")
def op_counts(spark, d):
    """Operations by kind and database."""
    return ops_of(spark, d).groupBy("op", "db").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("req").alias("n_requests"), F.countDistinct("field").alias("n_fields"))


@query("op_seq_order", f"WITH {_OPS} SELECT req, seq, event_id, op, field FROM ops")
def op_seq_order(spark, d):
    """Request index sequence."""
    return ops_of(spark, d).select("req", "seq", "event_id", "op", "field")


_STAMP = "'t' || (event_id % 13) || '.t' || (k % 24) || CASE WHEN k % 3 = 0 THEN '.t' || (k % 7) ELSE '' END"


@query("t_order_sort", f"WITH {_OPS}, s AS (SELECT event_id, {_STAMP} AS t, 't' || (k % 13) AS u FROM ops), p AS (SELECT *, [CAST(substr(x, 2) AS INT) FOR x IN string_split(t, '.')] AS v, [CAST(substr(u, 2) AS INT)] AS w FROM s) SELECT event_id, t, len(v) AS depth, v < w AS is_less, v > w AS is_greater, row_number() OVER (ORDER BY v, event_id) AS rank FROM p")
def t_order_sort(spark, d):
    """Program-order stamps parsed, compared and ranked."""
    k = F.col("k")
    part = lambda x: F.concat(F.lit("t"), x.cast("string"))
    t = F.concat(part(F.col("event_id") % 13), F.lit("."), part(k % 24), F.when(k % 3 == 0, F.concat(F.lit("."), part(k % 7))).otherwise(F.lit("")))
    s = ops_of(spark, d).select("event_id", t.alias("t"), part(k % 13).alias("u")).withColumn("v", order.parse_stamp(F.col("t")))
    return global_row_number(s, "rank", "v", "event_id").select("event_id", "t", F.size("v").cast("long").alias("depth"), order.less(F.col("t"), F.col("u")).alias("is_less"), order.greater(F.col("t"), F.col("u")).alias("is_greater"), "rank")


_PATH = "field || CASE WHEN k % 3 = 0 THEN '.sub' WHEN k % 3 = 1 THEN '[*].item.id' ELSE '' END"


def _path_column():
    k = F.col("k")
    return F.concat("field", F.when(k % 3 == 0, ".sub").when(k % 3 == 1, "[*].item.id").otherwise(""))


@query("path_split", f"""WITH {_OPS}, s AS (SELECT event_id, {_PATH} AS p FROM ops)
    SELECT event_id, p, regexp_extract(p, '^(.*)(\\.[^.]*)$', 1) AS upper, regexp_extract(p, '^(.*)(\\.[^.]*)$', 2) AS last, split_part(p, '.', 1) AS db, split_part(p, '.', 2) AS schema,
           regexp_extract(p, '^[^.]*\\.[^.]*\\.(.*)$', 1) AS name, regexp_replace(p, '^([^.]*\\.[^.]*\\.[^.\\[]*)(.*)$', '\\1!\\2') AS marked FROM s""")  # fmt: skip
def path_split(spark, d):
    """Parts of database paths."""
    p = F.col("p")
    return ops_of(spark, d).select("event_id", _path_column().alias("p")).select(
        "event_id", "p", paths.upper_path(p).alias("upper"), paths.last_segment(p).alias("last"), paths.database_name(p).alias("db"), paths.schema_name(p).alias("schema"),
        paths.field_name(p).alias("name"), paths.insert_after_field(p, F.lit("!")).alias("marked"),
    )


@query("path_ancestors", f"WITH {_OPS}, s AS (SELECT DISTINCT {_PATH} AS p FROM ops), q AS (SELECT p, string_split(p, '.') AS x FROM s), u AS (SELECT p, x, unnest(range(1, len(x))) AS i FROM q) SELECT p, array_to_string(x[1:i], '.') AS up FROM u")
def path_ancestors(spark, d):
    """Upper paths of every path, exploded for equi-joins."""
    return ops_of(spark, d).select(_path_column().alias("p")).distinct().select("p", F.explode(paths.ancestors(F.col("p"))).alias("up"))


@query("prefix_fields", f"WITH {_OPS}, f AS (SELECT DISTINCT field AS path, db FROM ops) SELECT a.path AS prefix, b.path FROM f a JOIN f b ON a.db = b.db AND starts_with(b.path, a.path)")
def prefix_fields(spark, d):
    """Fields of a schema below a path, by raw prefix."""
    f = ops_of(spark, d).select(F.col("field").alias("path"), "db", F.lit("c").alias("schema")).distinct()
    return graph.fields_with_prefix(f, f.select(F.col("path").alias("prefix"), "db", "schema"))


_SV = "'Service' || (k % 5) || '.Method' || (k % 3) || '.t' || (k % 20) || CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN '.Field' WHEN k % 4 = 2 THEN '[*]' ELSE '[*].Field' END"


@query("trace_arg_path", f"""WITH {_OPS}, s AS (SELECT event_id, {_SV} AS p FROM ops), x AS (SELECT *, split_part(p, '.', 3) AS third, regexp_extract(p, '^[^.]*\\.[^.]*\\.[^.]*(\\..*)$', 1) AS rest FROM s)
    SELECT event_id, p, split_part(third, '[*]', 1) AS arg, '_obj' || CASE WHEN rest <> '' THEN rest WHEN contains(third, '[*]') THEN substr(third, strpos(third, '[*]')) ELSE '' END AS objpath FROM x""")
def trace_arg_path(spark, d):
    """Argument and object path of service paths."""
    k, p = F.col("k"), F.col("p")
    s = F.concat(F.lit("Service"), (k % 5).cast("string"), F.lit(".Method"), (k % 3).cast("string"), F.lit(".t"), (k % 20).cast("string"), F.when(k % 4 == 0, "").when(k % 4 == 1, ".Field").when(k % 4 == 2, "[*]").otherwise("[*].Field"))
    return ops_of(spark, d).select("event_id", s.alias("p")).select("event_id", "p", paths.trace_argument(p).alias("arg"), paths.trace_object_path(p).alias("objpath"))


@query("func_short_path", """WITH s AS (SELECT c_custkey, '(*host.org/x/workflow/app' || (c_custkey % 3) || '.' || replace(lower(c_mktsegment), ' ', '') || 'ServiceImpl).Run' || (c_custkey % 7) AS p FROM customer)
    SELECT c_custkey, 'app' || (c_custkey % 3) || '.' || regexp_extract(p, '\\.([a-z]*Service)Impl', 1) || '.Run' || (c_custkey % 7) AS short, regexp_extract(p, '\\.([a-z]*Service)Impl', 1) AS service, 'Run' || (c_custkey % 7) AS method FROM s""")
def func_short_path(spark, d):
    """Short paths, services and methods of qualified functions."""
    key = F.col("c_custkey")
    p = F.concat(F.lit("(*host.org/x/workflow/app"), (key % 3).cast("string"), F.lit("."), F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("")), F.lit("ServiceImpl).Run"), (key % 7).cast("string"))
    s = table(spark, d, "customer").select("c_custkey", names.short_function_path(p).alias("short"))
    return s.select("c_custkey", "short", names.service_of(F.col("short")).alias("service"), names.method_of(F.col("short")).alias("method"))


@query("bson_tag", """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '_id' ELSE 'size' || p_size END END AS name FROM part""")
def bson_tag(spark, d):
    """Names in struct tags, options dropped."""
    key = F.col("p_partkey")
    inner = F.when(key % 2 == 0, F.lit("_id")).otherwise(F.concat(F.lit("size"), F.col("p_size").cast("string")))
    tag = F.when(key % 3 == 0, F.concat(F.lit('json:"x" bson:"'), inner, F.lit(',omitempty"'))).when(key % 3 == 1, F.concat(F.lit('bson:"'), inner, F.lit('"'))).otherwise(F.lit('json:"y"'))
    return table(spark, d, "part").select("p_partkey", names.bson_name(tag).alias("name"))


@query("call_graph_counts", f"WITH {_OPS} SELECT count(*) AS n_calls, count(*) FILTER (op = 'R') AS n_reads, count(*) FILTER (op IN ('W','U')) AS n_writes, count(*) FILTER (op = 'D') AS n_deletes, count(DISTINCT req) AS n_requests, count(DISTINCT db) AS n_databases FROM ops")
def call_graph_counts(spark, d):
    """Size of the call graph."""
    o = F.col("op")
    return ops_of(spark, d).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(names.is_read(o)).alias("n_reads"), F.count_if(names.is_write_or_update(o)).alias("n_writes"), F.count_if(names.is_delete(o)).alias("n_deletes"),
        F.countDistinct("req").alias("n_requests"), F.countDistinct("db").alias("n_databases"),
    )


@query("arg_param_join", "SELECT l_orderkey AS call_id, l_suppkey AS callee, l_linenumber AS pos, l_partkey AS obj, s_name AS param FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_linenumber = s_nationkey % 7 + 1")
def arg_param_join(spark, d):
    """Arguments matched to parameters by callee and position."""
    args = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("callee"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("obj"))
    params = table(spark, d, "supplier").select(F.col("s_suppkey").alias("callee"), (F.col("s_nationkey") % 7 + 1).alias("pos"), F.col("s_name").alias("param"))
    return graph.match_arguments(args, params)


@query("queue_match", f"WITH {_OPS} SELECT push, pop, queue FROM (SELECT a.event_id AS push, b.event_id AS pop, a.req AS queue, row_number() OVER (PARTITION BY a.event_id ORDER BY b.seq) AS i FROM ops a JOIN ops b ON a.req = b.req AND b.seq > a.seq AND a.op = 'W' AND b.op = 'R') WHERE i = 1")
def queue_match(spark, d):
    """Each push with the first later pop of its queue."""
    o = ops_of(spark, d).select(F.col("req").alias("queue"), F.col("event_id").alias("id"), F.col("seq").alias("ord"), "op")
    return graph.queue_hops(o.where("op = 'W'"), o.where("op = 'R'"))


@query("taint_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def taint_pairs(spark, d):
    """Ordered pairs of operations on one object in different databases."""
    return references.operation_pairs(ops_of(spark, d))


@query("taint_dedup", f"WITH {_OPS} SELECT req, obj, field, op, min(seq) AS seq, count(*) AS n FROM ops GROUP BY req, obj, field, op")
def taint_dedup(spark, d):
    """One taint per object, field and operation kind, the earliest."""
    return ops_of(spark, d).groupBy("req", "obj", "field", "op").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))


@query("t_range_filter", f"WITH {_OPS}, m AS (SELECT req, max(seq) // 2 AS mid FROM ops GROUP BY req) SELECT o.req, count(*) FILTER (seq <= mid) AS n_before, count(*) FILTER (seq >= mid) AS n_after FROM ops o JOIN m USING (req) GROUP BY o.req")
def t_range_filter(spark, d):
    """Taints up to and from a stamp; the stamp is in both."""
    o = ops_of(spark, d)
    mid = o.groupBy("req").agg(F.floor(F.max("seq") / 2).alias("mid"))
    s, m = F.col("seq"), F.col("mid")
    return o.join(mid, "req").groupBy("req").agg(F.count_if(graph.stamp_window(s, m, False)).alias("n_before"), F.count_if(graph.stamp_window(s, m, True)).alias("n_after"))


for _rule, _name in (("R1", "fk_write_write"), ("R2", "fk_read_write"), ("R3", "fk_write_read"), ("R4", "fk_read_read")):

    @query(_name, f"WITH {_RULES} SELECT src, dst, count(*) AS n FROM rules WHERE rule = '{_rule}' AND creates GROUP BY src, dst")
    def _of_rule(spark, d, rule=_rule):
        """Pairs that one rule makes references of."""
        return counted_rules_of(spark, d).where((F.col("rule") == rule) & F.col("creates")).groupBy("src", "dst").agg(F.sum("n").alias("n"))


@query("fk_first_pairs", f"WITH {_RULES} SELECT lo, hi, src, dst, rule, req, seq1, seq2 FROM firsts")
def fk_first_pairs(spark, d):
    """The pair that fixed each reference's direction."""
    return references.first_references(references.pair_rules(references.extreme_pairs(ops_of(spark, d), first=True))).select("lo", "hi", "src", "dst", "rule", "req", "seq1", "seq2")


@query("fk_infer", f"WITH {_FK} SELECT src, dst, mandatory, n_votes FROM fk")
def fk_infer(spark, d):
    """All inferred references."""
    return refs_of(spark, d).select("src", "dst", "mandatory", "n_votes")


@query("fk_mandatory", f"WITH {_FK} SELECT src, dst, n_votes FROM fk WHERE mandatory")
def fk_mandatory(spark, d):
    """References all of whose requests voted mandatory."""
    return refs_of(spark, d).where("mandatory").select("src", "dst", "n_votes")


@query("fk_requests_true", f"WITH {_FK} SELECT src, dst, req FROM votes WHERE vote")
def fk_requests_true(spark, d):
    """Requests that voted a reference mandatory."""
    return references.infer_votes(ops_of(spark, d)).where("vote").select("src", "dst", "req")


@query("fk_infer_ordered", None)
def fk_infer_ordered(spark, d):
    """References by the ordered fold with transitive replacement; the events are one application."""
    return references.folded_references(rules_of(spark, d).withColumn("app", F.lit("events"))).select("src", "dst", "mandatory", "transitive")


@query("fk_closure", f"WITH RECURSIVE {_FK}, m AS (SELECT src, dst FROM fk WHERE mandatory), c AS (SELECT src, dst FROM m UNION SELECT c.src, m.dst FROM c JOIN m ON c.dst = m.src) SELECT src, dst FROM c")
def fk_closure(spark, d):
    """Fields connected by mandatory references."""
    return graph.closure(refs_of(spark, d).where("mandatory"))


@query("schema_json", f"WITH {_FK} SELECT src_db AS db, string_agg('FOREIGN_KEY ' || src || ' REFERENCES ' || dst, '; ' ORDER BY src, dst) AS constraints FROM fk GROUP BY src_db")
def schema_json(spark, d):
    """Constraint strings of each database, sorted."""
    r = detectors.with_databases(refs_of(spark, d))
    label = names.constraint_label(F.lit("FOREIGN_KEY"), F.array("src", "dst"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", label.alias("label")))), lambda x: x["label"])
    return r.groupBy(F.col("src_db").alias("db")).agg(F.array_join(listed, "; ").alias("constraints"))


_CASCADE = f"""{_FK}, {_DAILY},
optional AS (SELECT DISTINCT src AS field, dst_db AS db FROM fk WHERE NOT mandatory),
written AS (SELECT DISTINCT o.req, p.db FROM dops o JOIN optional p ON starts_with(p.field, o.field) WHERE o.op = 'W'),
dels AS (SELECT o.req, o.seq, o.event_id, o.db, o.obj, max(CASE WHEN w.db IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY o.req ORDER BY o.seq ROWS UNBOUNDED PRECEDING) AS silent
         FROM dops o LEFT JOIN written w ON o.req = w.req AND o.db = w.db WHERE o.op = 'D'),
referencing AS (SELECT DISTINCT dst_db AS db, src_db AS pending_db, src AS pending FROM fk WHERE src_db <> 'db5' AND src_db <> dst_db),
live AS (SELECT * FROM dels WHERE silent = 0 AND db IN (SELECT db FROM referencing)),
settled AS (SELECT DISTINCT a.req, a.seq, b.db AS pending_db FROM live a JOIN live b ON a.req = b.req AND a.obj = b.obj AND b.seq > a.seq AND a.db <> b.db),
cascades AS (SELECT l.req, l.seq, l.event_id, l.db, r.pending_db, string_agg(r.pending, ', ' ORDER BY r.pending) AS fields
             FROM live l JOIN referencing r ON l.db = r.db LEFT JOIN settled s ON s.req = l.req AND s.seq = l.seq AND s.pending_db = r.pending_db WHERE s.req IS NULL GROUP BY ALL)"""


@query("detect_cascade", f"WITH {_CASCADE} SELECT * FROM cascades")
def detect_cascade(spark, d):
    """Deletes without the cascades that references ask for."""
    return detectors.missing_cascades(*daily_ops_and_refs_of(spark, d))


@query("cascade_suppressed", f"WITH {_CASCADE} SELECT * FROM cascades WHERE pending_db <> 'db1' AND NOT (pending_db = 'db2' AND db = 'db3')")
def cascade_suppressed(spark, d):
    """Missing cascades less the suppressed ones: db1 always, db2 when triggered by db3."""
    ignored = spark.createDataFrame([("db1", None), ("db2", "db3")], "db string, trigger_db string")
    return detectors.missing_cascades(*daily_ops_and_refs_of(spark, d), ignored)


@query("detect_concurrency", f"""WITH {_FK}, r AS (SELECT DISTINCT dst_db AS db, src AS field FROM fk WHERE NOT mandatory),
    hits AS (SELECT r.db, r.field, count(*) AS n_conflicts FROM r JOIN ops x ON x.op = 'D' AND x.db = r.db JOIN ops w ON w.op = 'W' AND starts_with(r.field, w.field) AND w.req <> x.req GROUP BY ALL)
    SELECT db, field, (SELECT count(*) FROM ops x WHERE x.op = 'D' AND x.db = hits.db) AS n_deletes, (SELECT count(*) FROM ops w WHERE w.op = 'W' AND starts_with(hits.field, w.field)) AS n_writes, n_conflicts FROM hits""")
def detect_concurrency(spark, d):
    """Deletes that race with writes of other requests."""
    return detectors.concurrent_writes(*ops_and_refs_of(spark, d))


_RACES = """optref AS (SELECT DISTINCT dst_db AS db, src AS field FROM fk WHERE NOT mandatory),
race_w AS (SELECT w.req, w.event_id, r.db, r.field FROM optref r JOIN ops w ON w.op = 'W' AND starts_with(r.field, w.field)),
races AS (SELECT x.req, x.event_id, x.db, count(DISTINCT w.event_id) AS n_writes, array_to_string(list_sort(list_distinct(list(w.field))), ', ') AS fields
          FROM ops x JOIN race_w w ON w.db = x.db AND w.req <> x.req WHERE x.op = 'D' GROUP BY ALL)"""


@query("delete_races", f"WITH {_FK}, {_RACES} SELECT * FROM races")
def delete_races(spark, d):
    """Deletes with the writes of other requests that they race with."""
    return detectors.dangerous_deletes(*ops_and_refs_of(spark, d))


@query("write_races", f"""WITH {_FK}, {_RACES} SELECT w.req, w.event_id, w.db, count(DISTINCT x.event_id) AS n_deletes, array_to_string(list_sort(list_distinct(list(w.field))), ', ') AS fields
    FROM race_w w JOIN ops x ON x.op = 'D' AND x.db = w.db AND x.req <> w.req GROUP BY w.req, w.event_id, w.db""")
def write_races(spark, d):
    """Writes with the deletes of other requests that they race with, and the fields they hit, grouped."""
    return detectors.conflicting_writes(*ops_and_refs_of(spark, d))


_COORD = f"""{_FK}, trues AS (SELECT src, dst, req FROM votes WHERE vote),
rp AS (SELECT a.req, a.event_id AS e1, b.event_id AS e2, a.field AS f1, b.field AS f2 FROM ops a JOIN ops b ON a.req = b.req AND a.obj = b.obj AND b.seq < a.seq AND a.db <> b.db AND a.op = 'R' AND b.op = 'R'),
cf AS (SELECT rp.*, {_NUM.format("f1")} % 5 = 0 AND {_NUM.format("f2")} % 5 = 0 AS both_pk, a.src IS NOT NULL AS a_exists,
              coalesce(a.mandatory, false) AND NOT EXISTS (SELECT 1 FROM trues t WHERE t.src = f1 AND t.dst = f2 AND t.req = rp.req) AS fresh_a,
              coalesce(b.mandatory, false) AND NOT EXISTS (SELECT 1 FROM trues t WHERE t.src = f2 AND t.dst = f1 AND t.req = rp.req) AS fresh_b
       FROM rp LEFT JOIN fk a ON a.src = f1 AND a.dst = f2 LEFT JOIN fk b ON b.src = f2 AND b.dst = f1)"""


@query("detect_fk_coord", f"WITH {_COORD} SELECT req, e1, e2, f1, f2 FROM cf WHERE NOT both_pk AND (fresh_a OR fresh_b)")
def detect_fk_coord(spark, d):
    """Uncoordinated reads along references."""
    return detectors.key_coordination(*ops_refs_votes_of(spark, d), primary=False)


@query("detect_pk_coord", f"WITH {_COORD} SELECT req, e1, e2, f1, f2 FROM cf WHERE both_pk AND CASE WHEN a_exists THEN fresh_a ELSE fresh_b END")
def detect_pk_coord(spark, d):
    """Uncoordinated reads of primary keys."""
    return detectors.key_coordination(*ops_refs_votes_of(spark, d), primary=True)


_UNIQUE = f"""{_OPS}, uniq AS (SELECT req, event_id, field, n_affected FROM (SELECT *, count(*) OVER (PARTITION BY req, obj ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_affected FROM ops WHERE op = 'W')
    WHERE n_affected > 0 AND {_NUM.format("field")} % 3 = 0 AND {_NUM.format("field")} % 5 <> 0)"""


@query("detect_unique", f"WITH {_UNIQUE} SELECT * FROM uniq")
def detect_unique(spark, d):
    """Writes of unique fields that taint later writes."""
    return detectors.unique_conflicts(ops_of(spark, d))


@query("warning_summary", f"WITH {_CASCADE}, {_COORD.removeprefix(_FK + ', ')}, {_UNIQUE.removeprefix(_OPS + ', ')}, {_RACES} SELECT 'missing_cascade' AS pattern, count(*) AS n FROM cascades UNION ALL SELECT 'fk_coordination', count(*) FROM cf WHERE NOT both_pk AND (fresh_a OR fresh_b) UNION ALL SELECT 'pk_coordination', count(*) FROM cf WHERE both_pk AND CASE WHEN a_exists THEN fresh_a ELSE fresh_b END UNION ALL SELECT 'unique_conflict', count(*) FROM uniq UNION ALL SELECT 'concurrent_write', CAST(coalesce(sum(n_writes), 0) AS BIGINT) FROM races")
def warning_summary(spark, d):
    """Number of findings of each of the five detectors; a delete and a write that race are one."""
    ops, refs, votes = ops_refs_votes_of(spark, d)
    found = {
        "missing_cascade": detectors.missing_cascades(stage(daily_ops_of(spark, d), "daily-operations"), refs), "fk_coordination": detectors.key_coordination(ops, refs, votes, False),
        "pk_coordination": detectors.key_coordination(ops, refs, votes, True), "unique_conflict": detectors.unique_conflicts(ops),
    }
    counts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("pattern"), "n") for k, x in found.items()]
    races = detectors.dangerous_deletes(ops, refs).agg(F.coalesce(F.sum("n_writes"), F.lit(0)).cast("long").alias("n"))
    return reduce(DataFrame.unionAll, [*counts, races.select(F.lit("concurrent_write").alias("pattern"), "n")])


@query("report_lines", f"WITH {_UNIQUE} SELECT row_number() OVER (ORDER BY req, event_id) AS n, '#' || row_number() OVER (ORDER BY req, event_id) || ' ' || field || ' @' || req || ': ' || n_affected AS line FROM uniq")
def report_lines(spark, d):
    """A numbered text report."""
    f = detectors.numbered(detectors.unique_conflicts(ops_of(spark, d)), "req", "event_id")
    return f.select("n", F.format_string("#%d %s @%d: %d", "n", "field", "req", "n_affected").alias("line"))


@query("request_traversal", "SELECT 'region' || n_regionkey AS entry, 'nation' || n_nationkey AS node, 1 AS depth FROM nation UNION ALL SELECT 'region' || n_regionkey, 'supplier' || s_suppkey, 2 FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def request_traversal(spark, d):
    """Everything called below each entry, with its depth: regions call nations, nations call suppliers."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    e = n.select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("int").alias("ord"))
    e = e.unionByName(s.select(name("nation", "s_nationkey").alias("src"), name("supplier", "s_suppkey").alias("dst"), F.col("s_suppkey").cast("int").alias("ord"))).withColumn("edge_id", F.concat_ws(".t", "dst", "ord"))
    entries = n.select(name("region", "n_regionkey").alias("node")).distinct().withColumn("entry", F.concat("node", F.lit(".Handle")))
    walked = graph.traverse(e, entries)
    reqs = global_row_number(entries, "req", "entry").select((F.col("req") - 1).cast("int").alias("req"), F.col("node").alias("entry"))
    return walked.join(reqs, "req").select("entry", "node", F.size("path").cast("int").alias("depth"))


@query("taint_fixpoint", f"""WITH RECURSIVE {_OPS}, has AS (SELECT DISTINCT req, k % 12 AS v FROM ops), e AS (SELECT a.req, a.v AS src, b.v AS dst FROM has a JOIN has b ON a.req = b.req AND b.v = (a.v + 1) % 12 WHERE a.v % 12 <> 11),
    r AS (SELECT req, k % 12 AS v FROM ops WHERE op = 'W' UNION SELECT e.req, e.dst FROM r JOIN e ON r.req = e.req AND r.v = e.src) SELECT req, v FROM r""")
def taint_fixpoint(spark, d):
    """Values that taints of writes reach over value-flow edges."""
    o = ops_of(spark, d)
    has = o.select("req", (F.col("k") % 12).alias("v")).distinct()
    e = stage(has.where("v <> 11").select("req", F.col("v").alias("src"), ((F.col("v") + 1) % 12).alias("dst")).join(has.withColumnRenamed("v", "dst"), ["req", "dst"]), "flow")
    seeds = o.where("op = 'W'").select("req", (F.col("k") % 12).alias("v"))
    return graph.fixpoint(seeds, lambda f: f.join(e, (f["req"] == e["req"]) & (f["v"] == e["src"])).select(f["req"], e["dst"].alias("v")), "taints")


@query("field_predicates", f"WITH {_FK} SELECT o.field, {_NUM.format('o.field')} % 5 = 0 AS is_pk, EXISTS (SELECT 1 FROM fk WHERE src = o.field) AS has_fk, EXISTS (SELECT 1 FROM fk WHERE src = o.field AND NOT mandatory) AS has_optional_fk FROM (SELECT DISTINCT field FROM ops) o")
def field_predicates(spark, d):
    """Key predicates of every field, by semi-joins."""
    f = ops_of(spark, d).select("field").distinct()
    refs = refs_of(spark, d).groupBy(F.col("src").alias("field")).agg(F.lit(True).alias("has_fk"), F.bool_or(~F.col("mandatory")).alias("optional"))
    return f.join(refs, "field", "left").select("field", is_primary(F.col("field")).alias("is_pk"), F.coalesce("has_fk", F.lit(False)).alias("has_fk"), F.coalesce("optional", F.lit(False)).alias("has_optional_fk"))


@query("ri_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def ri_orphans(spark, d):
    """Orders whose customer is missing."""
    return checks.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("pk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def pk_duplicates(spark, d):
    """Repeated keys of line items."""
    return checks.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("sql_effects", """WITH p AS (SELECT p_partkey, p_partkey % 4 AS m FROM part)
    SELECT p_partkey, op, path, role FROM p JOIN (VALUES (0, 'write', 'part.p_name', 'value'), (0, 'write', 'part.p_size', 'value'), (1, 'read', 'part.p_name', 'value'), (1, 'read', 'part.p_partkey', 'key'),
        (2, 'update', 'part.p_size', 'value'), (2, 'update', 'part.p_partkey', 'key'), (3, 'delete', 'part.p_partkey', 'key')) v(m, op, path, role) ON p.m = v.m""")
def sql_effects(spark, d):
    """Columns that parametrised statements touch."""
    s = F.element_at(F.array(*map(F.lit, (
        "INSERT INTO part (p_name, p_brand, p_size) VALUES (?, 'x', ?)", "SELECT p.p_name FROM part p WHERE p.p_partkey = ?", "update part set p_size = ? where p_partkey = ?", "DELETE FROM part WHERE p_partkey = ?",
    ))), (F.col("p_partkey") % 4 + 1).cast("int"))
    parsed = statements.with_effects(table(spark, d, "part").select("p_partkey", s.alias("statement")), "statement")
    return parsed.select("p_partkey", F.explode("effects").alias("e")).select("p_partkey", "e.op", "e.path", "e.role")

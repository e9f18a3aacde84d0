"""Sinks: application and schema JSON, numbered text reports with their changes, DOT graphs and text of value graphs, registry source, run metrics."""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import constraint_label, dot_id, dot_label, import_alias, spec_method
from ..plans.ranking import global_row_number
from ..sources.files import changed_lines, previous_lines


def app_json(services: DataFrame, databases: DataFrame) -> DataFrame:
    """One JSON document (value) per application: sorted services with their members, sorted databases."""
    member = F.struct("service", F.array_sort("deps").alias("deps"), "fields", F.array_sort("methods").alias("methods"))
    s = services.groupBy("app").agg(F.array_sort(F.collect_list(member)).alias("services"))
    d = databases.groupBy("app").agg(F.array_sort(F.collect_list(F.struct("db", "kind"))).alias("databases"))
    return s.join(d, "app", "full").select("app", F.to_json(F.struct("app", "services", "databases")).alias("value"))


def schema_document(fields: DataFrame, constraints: DataFrame) -> DataFrame:
    """One JSON document (value) per database and schema: sorted fields and constraint strings."""
    owner = F.split(F.element_at("fields", 1), r"\.")
    c = constraints.select("app", owner[0].alias("db"), owner[1].alias("schema"), constraint_label(F.col("type"), F.col("fields")).alias("label"))
    c = c.groupBy("app", "db", "schema").agg(F.array_sort(F.collect_set("label")).alias("constraints"))
    f = fields.groupBy("app", "db", "schema").agg(F.array_sort(F.collect_set("path")).alias("fields"))
    joined = f.join(c, ["app", "db", "schema"], "full")
    none = F.array().cast("array<string>")
    return joined.select("app", "db", "schema", F.to_json(F.struct("db", "schema", F.coalesce("fields", none).alias("fields"), F.coalesce("constraints", none).alias("constraints"))).alias("value"))


def write_report(lines: DataFrame, path: str, previous: DataFrame | None = None) -> DataFrame:
    """Write ``line`` rows as text, sorted by ``n``; returns (status, line) against the previous report."""
    lines.orderBy("n").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    new = lines.select("line")
    return changed_lines(previous if previous is not None else new.limit(0), new)


def call_graph_dot(nodes: DataFrame, edges: DataFrame, detailed: bool = False) -> DataFrame:
    """Lines (value) of a DOT graph: nodes (node, kind) and edges (src, dst, method, op, ord)."""
    shape = F.when(F.col("kind") == "DATABASE", "cylinder").when(F.col("kind") == "CLIENT", "oval").otherwise("box")
    n = nodes.select(F.lit(1).alias("part"), F.col("node").alias("k"), F.format_string('  %s [label="%s", shape=%s];', dot_id(F.col("node")), dot_label(F.col("node")), shape).alias("value"))
    label = F.concat_ws(" ", "method", F.when(F.lit(detailed), F.concat(F.lit("["), F.col("op"), F.lit("]"))))
    e = edges.select(F.lit(2).alias("part"), F.lpad(F.col("ord").cast("string"), 12, "0").alias("k"), F.format_string('  %s -> %s [label="%s"];', dot_id(F.col("src")), dot_id(F.col("dst")), dot_label(label)).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "", "digraph G {"), (3, "", "}")], "part int, k string, value string")
    return ends.unionByName(n).unionByName(e).orderBy("part", "k").select("value")


def value_graph_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (value) of the DOT graph of one function: nodes (id, name) and edges (src, dst, etype, ord)."""
    return call_graph_dot(nodes.select(F.concat_ws(" ", "id", "name").alias("node"), F.lit("VALUE").alias("kind")), edges.select("src", "dst", F.col("etype").alias("method"), F.lit("").alias("op"), "ord"))


def value_graph_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line (fn, n, line) per value of a function, in order of node ids: its name, kind, and the edges out of it."""
    out = edges.groupBy("fn", F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.col("etype"), F.lit(" -> "), F.col("dst")).alias("to")))).alias("e"))
    rows = nodes.join(out, ["fn", "id"], "left")
    to = F.array_join(F.transform(F.coalesce("e", F.array().cast("array<struct<ord:int,to:string>>")), lambda x: x["to"]), ", ")
    n = F.row_number().over(Window.partitionBy("fn").orderBy("id")).cast("long")
    return rows.select("fn", n.alias("n"), F.concat(F.col("id"), F.lit(" = "), F.col("kind"), F.when(to != "", F.concat(F.lit(": "), to)).otherwise(F.lit(""))).alias("line"))


def registry_source(apps: DataFrame) -> DataFrame:
    """Lines (part, name, line) of a generated registry: an import and a case for each application (name, app_root, spec_name, spec_path)."""
    alias, method = import_alias(F.col("name")), spec_method(F.col("name"), F.col("spec_name"))
    imports = apps.select(F.lit("import").alias("part"), "name", F.format_string('\t%s "%s"', alias, F.concat_ws("/", "app_root", "spec_path")).alias("line"))
    cases = apps.select(F.lit("case").alias("part"), "name", F.format_string('\tcase "%s": return %s.%s', "name", alias, method).alias("line"))
    return imports.unionByName(cases)


def _numbered(findings: DataFrame, *ids: str) -> DataFrame:
    """Findings with their number ``n`` in report order: by the entry of the request and the call string, where findings have them (entry, call), then by their ids."""
    return global_row_number(findings, "n", *(c for c in ("entry", "call") if c in findings.columns), *ids)


def with_entries(findings: DataFrame, requests: DataFrame, calls: DataFrame, key: str = "event_id") -> DataFrame:
    """Findings with the entry of their request (req, entry) and the string of their call (``key``, call)."""
    return findings.join(requests.select("req", "entry"), "req").join(calls.select(F.col("event_id").alias(key), "call"), key)


def cascade_report(findings: DataFrame) -> DataFrame:
    """Numbered lines (n, line) of missing cascades, by request, delete and database."""
    f = _numbered(findings, "req", "seq", "pending_db")
    return f.select("n", F.format_string("delete %d.%d: %s\tmissing cascade #%d: database={%s}, pending_fields={%s}", "req", "seq", "db", "n", "pending_db", "fields").alias("line"))


def race_report(findings: DataFrame) -> DataFrame:
    """Numbered lines of deletes that race with writes of other requests."""
    f = _numbered(findings, "req", "event_id", "db")
    return f.select("n", F.format_string("delete #%d: %d.%d, database={%s}, writes=%d, written_fields={%s}", "n", "req", "event_id", "db", "n_writes", "fields").alias("line"))


def coordination_report(findings: DataFrame, primary: bool) -> DataFrame:
    """Numbered lines of uncoordinated reads of primary keys or along references."""
    f = _numbered(findings, "req", "e1", "e2", "f1", "f2")
    return f.select("n", F.format_string(("PRIMARY" if primary else "FOREIGN") + " KEY READS #%d: request %d, READ %d: %s, READ %d: %s", "n", "req", "e1", "f1", "e2", "f2").alias("line"))


def unique_report(findings: DataFrame) -> DataFrame:
    """Numbered lines of writes of unique fields that taint later writes."""
    f = _numbered(findings, "req", "event_id")
    return f.select("n", F.format_string("write #%d: %d.%d, field (constrained): %s (UNIQUE), affected writes=%d", "n", "req", "event_id", "field", "n_affected").alias("line"))


def save_reports(findings: dict[str, DataFrame], folder: str, earlier: str | None = None) -> DataFrame:
    """The five reports (cascade, race, foreign, primary, unique) written as text below ``folder``; (report, status, line) against those below ``earlier``."""
    lines = {"cascade": cascade_report, "race": race_report, "foreign": lambda f: coordination_report(f, False), "primary": lambda f: coordination_report(f, True), "unique": unique_report}
    out = []
    for name, found in findings.items():
        previous = previous_lines(found.sparkSession, f"{earlier}/{name}.txt") if earlier else None
        out.append(write_report(lines[name](found), f"{folder}/{name}.txt", previous).select(F.lit(name).alias("report"), "status", "line"))
    return reduce(DataFrame.unionByName, out)


def metrics_yaml(metrics: DataFrame) -> DataFrame:
    """Lines (value) ``name: number`` of metrics (name, number)."""
    return metrics.select(F.concat_ws(": ", "name", F.col("number").cast("string")).alias("value"))


class Metrics:
    """Seconds of named steps and counters of a run, written as YAML: one ``name: number`` a line, sorted by name."""

    def __init__(self) -> None:
        self.values: dict[str, float] = {}
        self.pending: list[Observation] = []

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        yield
        self.values[f"{name}_s"] = round(time.perf_counter() - began, 6)

    def count(self, name: str, number: int) -> None:
        self.values[name] = number

    def observed(self, df: DataFrame, name: str, **counters: Column) -> DataFrame:
        """``df``, whose next job counts these as it runs; they are read when the metrics are written."""
        self.pending.append(seen := Observation(name))
        return df.observe(seen, *(c.alias(k) for k, c in counters.items()))

    def write(self, spark: SparkSession, path: str, app: str | None = None) -> None:
        """All values; those of jobs that were observed and have run, too."""
        for seen in self.pending:
            self.values |= seen.get
        values = {**({"app": app} if app else {}), **self.values}
        lines = spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "name string, number string")
        metrics_yaml(lines).coalesce(1).write.mode("overwrite").text(path)

"""Foreign-key inference from ordered pairs of operations on a shared object.

Op 1 is the earlier one of a pair in different databases.  Two writes: field 2 references field 1, mandatory; read then write: the same,
optional; write then key read: field 1 references field 2, optional; two key reads: field 2 references field 1, optional.  Deletes infer
nothing.  The first pair of two fields fixes the direction; later pairs of strict writes add votes.  A reference is
mandatory if it has votes and each request's vote is true, where true sticks within a request.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_read, is_write, is_write_or_update
from ..plans.config import AnalysisConfig
from ..plans.staging import input_tasks

PAIR_COLUMNS = ("req", "obj", "seq1", "seq2", "e1", "e2", "op1", "op2", "rk1", "rk2", "rv1", "rv2", "f1", "f2", "db1", "db2")


def operation_pairs(ops: DataFrame) -> DataFrame:
    """Pairs of operations of one request on one object, in program order, in different databases.

    An equi-join on (request, object); the order is a residual condition.
    """
    side = lambda i: ops.select("req", "obj", *(F.col(a).alias(f"{b}{i}") for a, b in (("seq", "seq"), ("event_id", "e"), ("op", "op"), ("rk", "rk"), ("rv", "rv"), ("field", "f"), ("db", "db"))))
    return side(1).join(side(2), ["req", "obj"]).where("seq1 < seq2 AND db1 <> db2").select(*PAIR_COLUMNS)


def pair_counts(ops: DataFrame) -> DataFrame:
    """Pairs of kinds of operations (op1, rk1, rv1, f1, db1 and the same with 2) and the number ``n`` of ordered pairs of operations of one request and object in different databases that have them.

    No pair is listed: an operation is repeated once for each kind that its object sees, and a running count over two kinds tells how many first operations come before each second one.
    """
    names = (("db", "db"), ("field", "f"), ("op", "op"), ("rk", "rk"), ("rv", "rv"))
    side = lambda df, i, *more: df.select("req", "obj", *more, *(F.col(a).alias(f"{b}{i}") for a, b in names))
    kinds = ops.groupBy("req", "obj", *(a for a, _ in names)).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    columns = [f"{b}{i}" for i in (1, 2) for _, b in names]
    met = lambda near, far: side(ops, near, "seq").join(side(kinds, far), ["req", "obj"]).where("db1 <> db2").select("req", "obj", *columns, "seq", F.lit(near == 1).cast("int").alias("is_first"))
    so_far = Window.partitionBy("req", "obj", *columns).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = met(1, 2).unionByName(met(2, 1)).withColumn("before", F.sum("is_first").over(so_far))
    return counted.where("is_first = 0 AND before > 0").groupBy(*columns).agg(F.sum("before").alias("n"))


def unordered_pairs(ops: DataFrame) -> DataFrame:
    """(req, lo, hi, obj): each two operations of one request on one object once, whichever comes first; of several objects the least."""
    other = ops.select("req", "obj", F.col("event_id").alias("hi"))
    pairs = ops.select("req", "obj", F.col("event_id").alias("lo")).join(other, ["req", "obj"]).where("lo < hi")
    return pairs.groupBy("req", "lo", "hi").agg(F.min("obj").alias("obj"))


def extreme_pairs(ops: DataFrame, first: bool) -> DataFrame:
    """Of the pairs of two kinds of operations on an object, the first one, or the last: all that references and their votes depend on.

    A kind is field and operation.  An object may see very many operations of a request, but few kinds: the first pair has the first operation of kind
    1 and the first one of kind 2 after it, the last pair the last operation of kind 2 and the last one of kind 1 before it.  Operations
    meet kinds, never each other.
    """
    names = (("db", "db"), ("field", "f"), ("op", "op"), ("rk", "rk"), ("rv", "rv"))
    end = F.min("seq") if first else F.max("seq")
    kinds = ops.groupBy("req", "obj", *(a for a, _ in names)).agg(end.alias("seq"))
    side = lambda df, i: df.select("req", "obj", F.col("seq").alias(f"seq{i}"), *(F.col(a).alias(f"{b}{i}") for a, b in names))
    near, far = (2, 1) if first else (1, 2)
    met = side(ops, near).join(side(kinds, far), ["req", "obj"]).where("seq1 < seq2 AND db1 <> db2")
    best = F.min(f"seq{near}") if first else F.max(f"seq{near}")
    keys = ["req", "obj", f"seq{far}", *(f"{b}{i}" for i in (1, 2) for _, b in names)]
    return met.groupBy(*keys).agg(best.alias(f"seq{near}"))


def rule_of(config: AnalysisConfig = AnalysisConfig()) -> Column:
    """Name of the rule that a pair falls under, or null."""
    a, b = F.col("op1"), F.col("op2")
    out = F.when(is_write_or_update(a) & is_write_or_update(b), "R1").when(is_read(a) & is_write_or_update(b), "R2").when(is_write_or_update(a) & is_read(b), "R3")
    if config.references_from_read_read:
        out = out.when(is_read(a) & is_read(b) & F.col("rk1") & F.col("rk2"), "R4")
        if config.references_from_read_value_key:
            out = out.when(is_read(a) & is_read(b) & F.col("rv1") & F.col("rk2"), "R5")
    return out


def pair_rules(pairs: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Pairs with a rule, the reference they would create (src, dst), whether they create one at all, and the pass that meets them (turn): with
    ``dual_pass`` pairs of reads come after all others."""
    forward = F.col("rule").isin("R3", "R5")
    return (
        pairs.withColumn("rule", rule_of(config))
        .where("rule IS NOT NULL")
        .withColumns({
            "src": F.when(forward, F.col("f1")).otherwise(F.col("f2")), "dst": F.when(forward, F.col("f2")).otherwise(F.col("f1")),
            "creates": ~((F.col("rule") == "R3") & F.col("rv2")),
            "lo": F.least("f1", "f2"), "hi": F.greatest("f1", "f2"),
            "turn": (F.lit(config.dual_pass) & F.col("rule").isin("R4", "R5")).cast("int"),
        })
    )


def first_references(rules: DataFrame) -> DataFrame:
    """For each unordered pair of fields the reference that its first creating pair made."""
    first = F.min(F.struct("turn", "req", "seq2", "seq1", "src", "dst", "rule")).alias("first")
    return rules.where("creates").groupBy("lo", "hi").agg(first).select("lo", "hi", "first.*")


def reference_votes(rules: DataFrame, firsts: DataFrame) -> DataFrame:
    """(src, dst, req, vote): per request, true sticks.  The pair that made a reference votes by its rule; of the others, ``rules``, the later ones do."""
    made = firsts.select("lo", "hi", F.struct("turn", "req", "seq2", "seq1").alias("born"), F.col("src").alias("fk_src"), F.col("dst").alias("fk_dst"))
    later = (
        F.when((F.col("rule") == "R1") & is_write(F.col("op1")) & is_write(F.col("op2")), F.lit(True))
        .when((F.col("rule") == "R2") & is_write(F.col("op2")), F.lit(False))
        .when((F.col("rule") == "R3") & is_write(F.col("op1")), F.lit(False))
    )
    joined = rules.join(made, ["lo", "hi"]).where(F.struct("turn", "req", "seq2", "seq1") > F.col("born"))
    votes = joined.select(F.col("fk_src").alias("src"), F.col("fk_dst").alias("dst"), "req", later.alias("vote")).where("vote IS NOT NULL")
    votes = votes.unionByName(firsts.select("src", "dst", "req", (F.col("rule") == "R1").alias("vote")))
    return votes.groupBy("src", "dst", "req").agg(F.bool_or("vote").alias("vote"))


def mandatory_references(votes: DataFrame) -> DataFrame:
    """(src, dst, mandatory, n_votes) of every reference."""
    return votes.groupBy("src", "dst").agg(F.bool_and("vote").alias("mandatory"), F.count(F.lit(1)).alias("n_votes"))


def infer_votes(ops: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(src, dst, req, vote) of all references of the operations."""
    firsts = first_references(pair_rules(extreme_pairs(ops, first=True), config))
    return reference_votes(pair_rules(extreme_pairs(ops, first=False), config), firsts)


def infer_references(ops: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """All references of the operations, by set operations: no transitive replacement, see ``fold_references`` for it."""
    return mandatory_references(infer_votes(ops, config))


@dataclass
class ReferenceFold:
    """The inference in creation order, with transitive replacement and the "no reference yet" test of key-read pairs.

    Both depend on what exists when a pair is met, so this is a fold over the pairs of one application in their order.
    Requests come one after the other, so only the last request of a reference is kept, and whether all earlier ones voted true; with ``dual_pass`` requests come twice, and all are kept.
    """

    config: AnalysisConfig = field(default_factory=AnalysisConfig)
    votes: dict[tuple[str, str], dict[int, bool]] = field(default_factory=dict)
    #: References that a request voted against which is no longer kept.
    refused: set[tuple[str, str]] = field(default_factory=set)
    transitive: set[tuple[str, str]] = field(default_factory=set)
    targets: dict[str, list[str]] = field(default_factory=dict)

    def mandatory(self, key: tuple[str, str]) -> bool:
        return key not in self.refused and bool(self.votes[key]) and all(self.votes[key].values())

    def _vote(self, key: tuple[str, str], req: int, value: bool) -> None:
        kept = self.votes[key]
        if kept and req not in kept and not self.config.dual_pass:
            if not all(kept.values()):
                self.refused.add(key)
            kept.clear()
        kept[req] = value or kept.get(req, False)

    def _create(self, src: str, dst: str, req: int, value: bool, transitive: bool = False) -> None:
        if (src, dst) not in self.votes:
            self.votes[src, dst] = {}
            self.targets.setdefault(src, []).append(dst)
        self._vote((src, dst), req, value)
        if transitive:
            self.transitive.add((src, dst))

    def _reference(self, src: str, dst: str, req: int, value: bool, both_write: bool) -> None:
        """src -> dst; if dst references other fields of other databases, src references those instead."""
        database = lambda p: p.split(".", 1)[0]
        instead = []
        if self.config.transitive_references:
            instead = [t for t in self.targets.get(dst, []) if t != dst and (t, src) not in self.votes and database(t) != database(src)]
        for t in instead:
            self._create(src, t, req, both_write and self.mandatory((dst, t)), transitive=True)
        if not instead:
            self._create(src, dst, req, value)

    def add(self, pair: dict) -> None:
        """One pair as ``pair_rules`` makes them."""
        f1, f2, rule, req = pair["f1"], pair["f2"], pair["rule"], pair["req"]
        known = next((k for k in ((f2, f1), (f1, f2)) if k in self.votes), None)
        if known:
            if rule == "R1" and pair["op1"] == pair["op2"] == "W":
                self._vote(known, req, True)
            elif (rule == "R2" and pair["op2"] == "W") or (rule == "R3" and pair["op1"] == "W"):
                self._vote(known, req, False)
        elif pair["creates"] and not (rule == "R4" and self.targets.get(f2)):
            self._reference(pair["src"], pair["dst"], req, rule == "R1", rule == "R1")

    def rows(self) -> list[tuple[str, str, bool, bool]]:
        return [(s, d, self.mandatory((s, d)), (s, d) in self.transitive) for s, d in sorted(self.votes)]


def fold_references(pairs: Iterable[dict], config: AnalysisConfig = AnalysisConfig()) -> ReferenceFold:
    fold = ReferenceFold(config)
    for p in pairs:
        fold.add(p)
    return fold


def folded_references(rules: DataFrame, app: str = "app", config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(app, src, dst, mandatory, transitive): the ordered fold, one application after the other; applications don't share references.

    Spark sorts the pairs of an application, on disk if need be, and the fold reads them in batches: Python holds one batch and the references.
    """
    import pyarrow as pa

    schema = f"{app} string, src string, dst string, mandatory boolean, transitive boolean"
    needed = ("req", "f1", "f2", "op1", "op2", "rule", "src", "dst", "creates")
    types = pa.schema([(app, pa.string()), ("src", pa.string()), ("dst", pa.string()), ("mandatory", pa.bool_()), ("transitive", pa.bool_())])

    def rows_of(name, fold):
        return pa.RecordBatch.from_pylist([dict(zip(types.names, (name, *r), strict=True)) for r in fold.rows()], types)

    def run(batches):
        name = fold = None
        for batch in batches:
            for pair in batch.to_pylist():
                if fold is None or pair[app] != name:
                    if fold is not None:
                        yield rows_of(name, fold)
                    name, fold = pair[app], ReferenceFold(config)
                fold.add(pair)
        if fold is not None:
            yield rows_of(name, fold)

    order = (app, "turn", "req", "seq2", "seq1")
    dealt = rules.repartition(input_tasks(rules.sparkSession), app).sortWithinPartitions(*order)
    return dealt.select(app, *needed).mapInArrow(run, schema)

"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression.  ``trigram_query`` derives from its syntax tree what every match must
contain: a conjunction of clauses, each a disjunction of trigram sets.  The index holds, for the trigrams that some rule asks for,
posting lists of document keys per block of documents; a rule's candidates are the intersections
and unions of posting lists that its query names, and only candidates are verified with the expression itself.
Rules without a mandatory trigram (a run of hex digits) are verified on every document.

Keys are 64-bit hashes of the row; two rows with one key are at worst verified in vain.  Posting lists are
bounded by ``BLOCK_DOCS``, so a trigram that every document has makes no large group.

Positions of the matches of one text are sums over their lengths, taken in short runs (``running``), so finding and redacting grow in
proportion to the text and its matches.

Defined results for odd input: null texts are empty, rows repeat as often as in the input, null ids are kept,
positions count code points, a text of any length with any number of matches is searched whole, an empty table gives an empty
result, and added columns never replace existing ones (``fresh_name``).
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import fresh_name, quoted

#: Documents of one block of the index, on average.
BLOCK_DOCS = 4096
#: Sets of strings larger than this are no longer tracked while a query is derived.
MAX_STRINGS = 48


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is read by Java's and by Python's engine alike.  A match counts if its group ``group`` has
    ``least`` code points or more; failing matches still use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds that are asked for, in their listed order.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that the method adds.
ADDED_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE_RULES + ADDED_RULES

#: Clauses that must all hold; each is a set of alternatives, each alternative a set of trigrams that must all occur.
Query = list[frozenset[frozenset[str]]]


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _strings(op, arg) -> set[str] | None:
    """All strings (lower case) that a node matches, or None when they are too many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MAX_STRINGS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4 and (part := _sequence_strings(arg[2])) is not None:
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            out |= power if n >= arg[0] else set()
            power = {a + b for a in power for b in part}
            if len(power) > MAX_STRINGS:
                return None
        return out
    return {""} if op is sre.AT else None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _strings(op, arg)
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match of ``pattern`` must contain; empty: nothing is mandatory."""
    clauses: Query = []

    def close(found: set[str]) -> None:
        alternatives = frozenset(trigrams(s) for s in found)
        if all(alternatives):  # a set that holds another one asks for nothing more
            clauses.append(frozenset(a for a in alternatives if not any(b < a for b in alternatives)))

    def walk(nodes) -> None:
        run = {""}
        for op, arg in nodes:
            part = _strings(op, arg)
            if part is not None and len(run) * len(part) <= MAX_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            close(run)
            run = {""}
            if op is sre.SUBPATTERN:
                walk(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
            elif part is not None:
                run = part
        close(run)

    walk(sre_parser.parse(pattern))
    return clauses


def _postings_of(query: Query, postings: Column) -> Column:
    """Keys that satisfy ``query``, from a map trigram -> keys."""
    none = F.array().cast("array<bigint>")
    asked = F.array(*(F.array(*(F.array(*map(F.lit, sorted(ts))) for ts in sorted(c, key=sorted))) for c in query))

    def of(t: Column) -> Column:
        return F.coalesce(F.try_element_at(postings, t), none)

    def every(ts: Column) -> Column:
        return F.aggregate(F.slice(ts, F.lit(2), F.size(ts)), of(F.element_at(ts, 1)), lambda acc, t: F.array_intersect(acc, of(t)))

    some = F.transform(asked, lambda clause: F.array_distinct(F.flatten(F.transform(clause, every))))
    return F.aggregate(F.slice(some, F.lit(2), F.size(some)), F.element_at(some, 1), lambda acc, ks: F.array_intersect(acc, ks))


def trigram_index(docs: DataFrame, key: str, text: Column, wanted: list[str], blocks: int) -> DataFrame:
    """(block, postings: map trigram -> keys) over ``wanted``; blocks deal documents out by their key."""
    low = docs.select(F.col(f"`{key}`").alias("k"), F.lower(text).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted)))
    # The outer form: for the plain one the optimizer adds a filter that computes all of `present` once more, unshared.
    entries = low.select("k", F.pmod("k", F.lit(blocks)).alias("block"), present.alias("ts")).select("k", "block", F.explode_outer("ts").alias("t")).where("t IS NOT NULL")
    lists = entries.groupBy("block", "t").agg(F.collect_set("k").alias("ks"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("t", "ks"))).alias("postings"))


def candidates(docs: DataFrame, key: str, text: Column, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(key, cand: kinds whose trigram query the document satisfies), for rules that have such a query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    wanted = sorted({t for q in queries.values() for c in q for ts in c for t in ts})
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    index = trigram_index(docs, key, text, wanted, blocks)
    found = F.array(*(F.struct(F.lit(k).alias("kind"), _postings_of(q, F.col("postings")).alias("ks")) for k, q in queries.items()))
    hits = index.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.ks").alias(key))
    return hits.groupBy(key).agg(F.collect_set("kind").alias("cand"))


#: Elements that one level of a running fold handles by itself.
FOLD = 32


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(xs: Column, join, levels: int = 3) -> Column:
    """For each element of an int array the ``join`` (a sum, a greatest one) of all before it, 0 for the first.

    A plain fold copies its output for every element.  Here short runs are folded, their totals are carried by a fold of the next level,
    and only flat ``transform`` steps see the whole array: the work grows in proportion to the array.
    """

    def fold(c: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(c, zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    if not levels:
        return fold(xs)

    def runs(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda i: F.size(v) > 0)
        return F.transform(starts, lambda i: F.slice(v, i * FOLD + 1, F.lit(FOLD)))

    def spread(cs: Column) -> Column:
        totals = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), join))
        return F.flatten(F.zip_with(cs, running(totals, join, levels - 1), lambda c, o: F.transform(fold(c), lambda x: join(x, o))))

    return _bind(xs, lambda v: _bind(runs(v), spread))


def match_spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Array of (start, rank, end, kind) of the leftmost non-overlapping matches of ``rule`` that pass its test.

    What stands between matches comes from a split, so every pass over the text is one scan; starts are sums of lengths.
    """
    lengths = lambda xs: F.transform(xs, F.length)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else None

    def spans(n: Column) -> Column:
        gap, hit, test = n["gap"], n["hit"], n["hit" if tested is None else "test"]
        before = running(F.zip_with(hit, F.slice(gap, F.lit(1), F.size(hit)), lambda h, g: h + g), lambda x, y: x + y)
        start = F.zip_with(before, gap, lambda x, g: x + g)
        rows = F.transform(F.arrays_zip(start.alias("s"), hit.alias("h"), test.alias("t")), lambda x: F.when(x["t"] >= rule.least, F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), (x["s"] + x["h"]).alias("end"), F.lit(rule.kind).alias("kind"))))
        return F.array_compact(rows)

    parts = [lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(hits).alias("hit")]
    return _bind(F.struct(*parts, *([] if tested is None else [lengths(tested).alias("test")])), spans)


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> tuple[DataFrame, str]:
    """``docs`` with an array column of spans (start, rank, end, kind) by start, then rule order; and that column's name."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key, cand = fresh_name("row_key", docs.columns), fresh_name("cand", docs.columns)
    ids = [F.col(quoted(c)) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]  # these have no hash; candidates depend on the text alone
    keyed = docs.withColumn(key, F.xxhash64(*ids))
    found = candidates(keyed, key, text, rules).withColumnRenamed("cand", cand)
    # Written by itself: the join can then split a row that repeats very often over tasks.
    joined = keyed.join(stage(found, "secret-candidates"), key, "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    lists = []
    for i, r in enumerate(rules):
        ask = F.coalesce(F.array_contains(cand, r.kind), F.lit(False)) if trigram_query(r.pattern) else F.rlike(text, F.lit(r.pattern))
        lists.append(F.when(ask, match_spans(text, r, i)).otherwise(none))
    spans = fresh_name("spans", docs.columns)
    return joined.select(*(F.col(quoted(c)) for c in docs.columns), F.sort_array(F.concat(*lists)).alias(spans)), spans


def spans_string(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Code points of one piece of a text that is cut at many places.
PIECE = 1024


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every run of overlapping or touching spans replaced by ``mark``.

    A place in a text is found by counting from its start, so the text is first cut into pieces; what stays is put together from these.
    """

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Code points [a, b), touching only the pieces they lie in."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.try_element_at(pieces, k + 1), F.lit(""))
        inner = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        apart = F.concat(F.substring(piece(i), a % PIECE + 1, F.lit(PIECE)), inner, F.substring(piece(j), F.lit(1), b % PIECE))
        return F.when(i == j, F.substring(piece(i), a % PIECE + 1, b - a)).otherwise(apart)

    def build(n: Column) -> Column:
        ends = F.transform(n["spans"], lambda x: x["end"])
        reach = running(ends, lambda x, y: F.greatest(x, y))
        zipped = F.zip_with(n["spans"], reach, lambda x, r: F.struct(x["start"].alias("start"), r.alias("reach")))
        # A run of spans begins where the text is past all spans before, or with the first span.
        firsts = F.filter(zipped, lambda x, i: (i == 0) | (x["start"] > x["reach"]))
        kept = F.transform(firsts, lambda x: F.concat(cut(n["pieces"], x["reach"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), cut(n["pieces"], F.array_max(ends), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(_bind(F.struct(spans.alias("spans"), pieces.alias("pieces")), build))

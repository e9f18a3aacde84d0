"""Parametrised SQL statements as rows of tokens: which columns each touches, and which column each placeholder is bound to.

A statement is cut into tokens by one pattern; a fold over them keeps a stack of open brackets, so that every token knows its select (``scope``), its clause and the bracket it stands in.  The rest are
windows over the tokens of a statement: neighbours, ordinals inside lists, the last column before a placeholder, the tables of a scope with their aliases.  Each distinct statement is read
once, however many rows have it; statements are texts of source code, so the window of one is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import input_tasks

_PART = r"(?:[A-Za-z_]\w*|\"[^\"]*\"|`[^`]*`)"
#: Literals, names of one or more parts, numbers, placeholders, operators.
TOKEN = rf"'(?:[^']|'')*'|{_PART}(?:\s*\.\s*(?:{_PART}|\*))*|\d+(?:\.\d+)?|\?|<>|!=|<=|>=|[-+*/%(),;=<>]"
COMPARISONS = ("=", "<>", "!=", "<", "<=", ">", ">=")
#: Words that begin a clause, and what the clause is.
CLAUSES = {
    "SELECT": "select", "FROM": "from", "JOIN": "from", "INTO": "into", "UPDATE": "update", "SET": "set", "WHERE": "where", "ON": "where", "HAVING": "where", "VALUES": "values",
    "USING": "using", "GROUP": "group", "ORDER": "order", "LIMIT": "limit", "OFFSET": "limit",
}
#: Words that are no names.
KEYWORDS = (
    *CLAUSES, "INSERT", "REPLACE", "DELETE", "AS", "BY", "AND", "OR", "NOT", "IN", "LIKE", "BETWEEN", "IS", "NULL", "INNER", "LEFT", "RIGHT", "OUTER", "FULL", "CROSS", "NATURAL", "UNION", "ALL", "DISTINCT",
    "ASC", "DESC", "EXISTS", "TRUE", "FALSE", "DEFAULT", "CASE", "WHEN", "THEN", "ELSE", "END", "DUPLICATE", "KEY",
)
OPERATIONS = {"SELECT": "read", "INSERT": "write", "REPLACE": "write", "UPDATE": "update", "DELETE": "delete"}

_FRAME = "struct<frame:int,list:int,scope:int,clause:string,own:boolean>"
_SEEN = "struct<pos:int,token:string,word:string,frame:int,list:int,scope:int,clause:string>"


def _either(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), key)


def _placed(statement: Column) -> Column:
    """Tokens of a statement with the bracket, list, scope and clause that each stands in."""
    words = F.transform(F.regexp_extract_all(statement, F.lit(TOKEN), 0), lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.when(F.rlike(t, F.lit(r"^[A-Za-z_]\w*$")), F.upper(t)).otherwise("").alias("word")))
    base = F.struct(F.lit(-1).alias("frame"), F.lit(-1).alias("list"), F.lit(-1).alias("scope"), F.lit("").alias("clause"), F.lit(True).alias("own")).cast(_FRAME)
    zero = F.struct(F.array(base).alias("stack"), F.array().cast(f"array<{_SEEN}>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        def moved(top: Column) -> Column:
            is_select = t["word"] == "SELECT"
            named = F.when((t["word"] == "UPDATE") & (t["pos"] > 0), F.lit("set")).otherwise(_either(CLAUSES, t["word"]))
            clause = F.when(is_select, F.lit("select")).when(top["own"] & named.isNotNull(), named).otherwise(top["clause"])
            return F.struct(top["frame"].alias("frame"), top["list"].alias("list"), F.when(is_select, t["pos"]).otherwise(top["scope"]).alias("scope"), clause.alias("clause"), (top["own"] | is_select).alias("own")).cast(_FRAME)

        def after(top: Column) -> Column:
            below = F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)
            # A bracket is part of a list unless a select begins in it; the outermost one names the list.
            opened = F.struct(t["pos"].alias("frame"), F.when(top["own"], t["pos"]).otherwise(top["list"]).alias("list"), top["scope"].alias("scope"), top["clause"].alias("clause"), F.lit(False).alias("own")).cast(_FRAME)
            stack = F.when(t["token"] == "(", F.concat(below, F.array(top, opened))).when((t["token"] == ")") & (F.size(acc["stack"]) > 1), below).otherwise(F.concat(below, F.array(top)))
            seen = F.struct(t["pos"].alias("pos"), t["token"].alias("token"), t["word"].alias("word"), top["frame"].alias("frame"), top["list"].alias("list"), top["scope"].alias("scope"), top["clause"].alias("clause")).cast(_SEEN)
            return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(seen)).alias("out"))

        return F.transform(F.array(moved(F.element_at(acc["stack"], -1))), after)[0]

    return F.aggregate(words, zero, step, lambda acc: acc["out"])


def statement_columns(statements: DataFrame, statement: str = "statement") -> DataFrame:
    """(statement, pos, op, path, role, placeholder, item) of each distinct statement.

    ``path`` is table.column; ``role`` is ``value`` for what is written or read, ``key`` for conditions on a placeholder, ``limit`` for counts of rows.  ``placeholder`` numbers the question
    marks from 1 and is null for columns that a select lists; ``item`` numbers those from 1.  Columns of a nested select are read, whatever the statement does.  A delete without a condition touches all columns.
    """
    texts = statements.select(F.col(f"`{statement}`").alias("statement")).where("statement IS NOT NULL").distinct().withColumn("sid", F.md5(F.col("statement").cast("binary")))
    tokens = texts.select("sid", F.explode(_placed(F.col("statement"))).alias("t")).select("sid", "t.*")
    by = Window.partitionBy("sid").orderBy("pos")
    everywhere = Window.partitionBy("sid")
    is_name = F.rlike("token", F.lit(r"^[A-Za-z_\"`]")) & ~F.col("word").isin(*KEYWORDS)
    named = tokens.withColumns({"name": F.when(is_name, F.regexp_replace(F.regexp_replace("token", r"\s*\.\s*", "."), r"[`\"]", ""))})
    around = named.withColumns({f"{c}_{k}": F.lag(c, -k).over(by) if k < 0 else F.lead(c, k).over(by) for c, k in (("token", 1), ("name", 1), ("word", 1), ("name", 2))} | {f"{c}_before": F.lag(c).over(by) for c in ("token", "name", "word")})
    name, clause = F.col("name"), F.col("clause")
    has_name = name.isNotNull()
    before = F.coalesce(F.col("word_before"), F.lit(""))
    is_table = has_name & (clause.isin("from", "into", "update")) & (before.isin("FROM", "JOIN", "INTO", "UPDATE") | ((clause == "from") & (F.col("token_before") == ",")))
    called = has_name & (F.coalesce(F.col("token_1"), F.lit("")) == "(") & ~is_table
    # "x AS y", "x y", "f(x) y": y names what stands before it.
    is_alias = has_name & ((before == "AS") | F.col("name_before").isNotNull() | (F.col("token_before") == ")"))
    alias = F.coalesce(F.when(F.col("word_1") == "AS", F.col("name_2")), F.col("name_1"), name)
    tables = F.collect_list(F.when(is_table, F.struct("pos", "scope", name.alias("table"), alias.alias("alias"))))
    marked = around.withColumns({
        "is_column": has_name & ~is_table & ~is_alias & ~called, "tables": F.array_sort(tables.over(everywhere)), "first_word": F.first("word").over(by),
        "placeholder": F.when(F.col("token") == "?", F.sum(F.when(F.col("token") == "?", 1).otherwise(0)).over(by)).cast("int"),
        "ordinal": F.sum(F.when((F.col("token") == ",") & (F.col("frame") == F.col("list")), 1).otherwise(0)).over(Window.partitionBy("sid", "list").orderBy("pos")).cast("int"),
    })
    in_scope = Window.partitionBy("sid", "scope", "clause").orderBy("pos")
    said = marked.withColumns({
        "last_column": F.last(F.when(F.col("is_column"), name), ignorenulls=True).over(in_scope), "assigned": F.last(F.when(F.col("is_column") & (F.col("token_1") == "="), name), ignorenulls=True).over(in_scope),
        "listed": F.collect_list(F.when(F.col("is_column") & (clause == "into"), F.struct("ordinal", name.alias("name")))).over(everywhere),
        "is_star": (clause == "select") & (F.col("token") == "*") & (before.isin("SELECT", "DISTINCT", "ALL") | (F.col("token_before") == ",")),
        "base": F.when(F.col("first_word") == "SELECT", 0).otherwise(-1),
    })
    is_bound = F.col("placeholder").isNotNull()
    faces = F.col("token_1").isin(*COMPARISONS) & F.col("name_2").isNotNull()
    inserted = F.filter("listed", lambda c: c["ordinal"] == F.col("ordinal"))
    column = (
        F.when(is_bound & (clause == "where"), F.when(faces, F.col("name_2")).otherwise(F.col("last_column"))).when(is_bound & (clause == "set"), F.col("assigned"))
        .when(is_bound & (clause == "values"), F.try_element_at(inserted, F.lit(1))["name"]).when(~is_bound & F.col("is_star"), F.lit("*")).when(~is_bound & F.col("is_column") & (clause == "select"), name)
    )
    role = F.when(is_bound & (clause == "where"), "key").when(is_bound & (clause == "limit"), "limit").otherwise("value")
    op = F.when((F.col("scope") == F.col("base")) | (F.col("first_word") != "SELECT") & (F.col("scope") == -1), _either(OPERATIONS, F.col("first_word"))).otherwise("read")
    rows = said.withColumns({"column": column, "role": role, "op": op}).where(is_bound | column.isNotNull())
    at_item = Window.partitionBy("sid", "scope", is_bound).orderBy("pos")
    item = F.when(~is_bound & (F.col("scope") == F.col("base")), F.row_number().over(at_item))
    found = rows.select("sid", "pos", "op", _resolved(F.col("column"), F.col("scope"), F.col("tables")).alias("path"), "role", "placeholder", item.cast("int").alias("item"))
    deleted = said.where((F.col("pos") == 0) & (F.col("first_word") == "DELETE")).select("sid", F.concat(F.try_element_at("tables", F.lit(1))["table"], F.lit(".*")).alias("path"))
    bare = deleted.join(found.where("role = 'key' AND op = 'delete'").select("sid"), "sid", "left_anti").where("path IS NOT NULL")
    whole = bare.select("sid", F.lit(0).alias("pos"), F.lit("delete").alias("op"), "path", F.lit("key").alias("role"), F.lit(None).cast("int").alias("placeholder"), F.lit(None).cast("int").alias("item"))
    return found.unionByName(whole).join(texts, "sid").drop("sid")


def _resolved(column: Column, scope: Column, tables: Column) -> Column:
    """``column`` with its table's name: that of its prefix among the tables of its scope, else of the statement; without a prefix the first table of the scope, else of the statement."""
    prefix, last = F.regexp_extract(column, r"^(.*)\.[^.]*$", 1), F.regexp_extract(column, r"([^.]*)$", 1)
    first = lambda cond: F.try_element_at(F.filter(tables, cond), F.lit(1))["table"]
    named = [lambda t: (t["scope"] == scope) & (t["alias"] == prefix), lambda t: (t["scope"] == scope) & (t["table"] == prefix), lambda t: t["alias"] == prefix]
    table = F.when(prefix != "", F.coalesce(*map(first, named), prefix)).otherwise(F.coalesce(first(lambda t: t["scope"] == scope), first(lambda t: t["table"].isNotNull())))
    return F.when(column.isNotNull(), reduce(F.concat, (table, F.lit("."), last)))


def with_effects(rows: DataFrame, statement: str, name: str = "effects") -> DataFrame:
    """``rows`` with the effects (op, path, role) of their statement, in the order of its text; an empty array if it has none."""
    found = statement_columns(rows, statement).where("path IS NOT NULL")
    order = F.array_sort(F.collect_list(F.struct("pos", "op", "path", "role")))
    effects = found.groupBy(F.col("statement").alias("_statement")).agg(F.transform(order, lambda e: F.struct(e["op"].alias("op"), e["path"].alias("path"), e["role"].alias("role"))).alias("_effects"))
    joined = rows.join(effects, F.col(f"`{statement}`") == F.col("_statement"), "left").drop("_statement")
    return joined.withColumn(name, F.coalesce("_effects", F.array().cast("array<struct<op:string,path:string,role:string>>"))).drop("_effects")


def bound_arguments(calls: DataFrame, arguments: DataFrame, destinations: DataFrame) -> DataFrame:
    """Columns that the values of relational calls hold: (call_id, id, path, role, op, pos).

    ``calls`` (call_id, statement); ``arguments`` (call_id, n, id): the n-th bound value, from 1; ``destinations`` (call_id, id): the value that a select reads into: it holds the first selected
    column, or the whole row if that is ``*``.
    """
    columns = statement_columns(calls)
    found = calls.select("call_id", "statement").join(columns, "statement").drop("statement")
    # Dealt by number: the planner would join tasks by their compressed size, and rows of few statements compress well.
    dealt = lambda df, *keys: df.repartition(input_tasks(df.sparkSession), *keys)
    placed = dealt(found.where("placeholder IS NOT NULL AND path IS NOT NULL").withColumnRenamed("placeholder", "n"), "call_id", "n").join(dealt(arguments.select("call_id", "n", "id"), "call_id", "n"), ["call_id", "n"])
    read = dealt(found.where("item = 1"), "call_id").join(dealt(destinations.select("call_id", "id"), "call_id"), "call_id").withColumn("n", F.lit(0))
    out = lambda df: df.select("call_id", "id", "path", "role", "op", F.col("n").alias("pos"))
    return out(placed).unionByName(out(read))

"""Keys from SQL DDL files: column- and table-level PRIMARY KEY, UNIQUE and FOREIGN KEY, composite ones too."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import ship_package

_CREATE = re.compile(r"^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([^\s(]+)\s*\((.*)\)[^)]*$", re.I | re.S)
_NAME = r"[`\"\[]?(\w+)[`\"\]]?"
_LIST = r"\(([^)]*)\)"
KEYS = "array<struct<table:string,type:string,fields:array<string>>>"


def top_level_parts(body: str) -> list[str]:
    """``body`` cut at commas outside parentheses and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            parts.append(body[start:i].strip())
            start = i + 1
    return [p for p in [*parts, body[start:].strip()] if p]


def _columns(text: str) -> list[str]:
    return [re.sub(r"[`\"\[\]\s]", "", c) for c in text.split(",")]


def parse_ddl(text: str) -> list[tuple[str, str, list[str]]]:
    """(table, PRIMARY | UNIQUE | FOREIGN_KEY, fields) in order; a foreign key's fields are column and table.column, pair by pair."""
    out = []
    for statement in re.sub(r"--[^\n]*", "", text or "").split(";"):
        if not (m := _CREATE.match(statement)):
            continue
        table = re.sub(r"[`\"\[\]]", "", m[1])
        for part in top_level_parts(m[2]):
            bare = re.sub(rf"^CONSTRAINT\s+{_NAME}\s+", "", part, flags=re.I)
            if k := re.match(rf"PRIMARY\s+KEY\s*{_LIST}", bare, re.I):
                out.append((table, "PRIMARY", _columns(k[1])))
            elif k := re.match(rf"UNIQUE(?:\s+(?:KEY|INDEX))?(?:\s+{_NAME})?\s*{_LIST}", bare, re.I):
                out.append((table, "UNIQUE", _columns(k[2])))
            elif k := re.match(rf"FOREIGN\s+KEY\s*{_LIST}\s+REFERENCES\s+([^\s(]+)\s*{_LIST}", bare, re.I):
                for a, b in zip(_columns(k[1]), _columns(k[3]), strict=False):
                    out.append((table, "FOREIGN_KEY", [a, f"{_columns(k[2])[0]}.{b}"]))
            elif (c := re.match(rf"{_NAME}\s+", bare)) and not re.match(r"(KEY|INDEX|CHECK)\b", bare, re.I):
                if re.search(r"\bPRIMARY\s+KEY\b", bare, re.I):
                    out.append((table, "PRIMARY", [c[1]]))
                elif re.search(r"\bUNIQUE\b", bare, re.I):
                    out.append((table, "UNIQUE", [c[1]]))
                if k := re.search(rf"\bREFERENCES\s+([^\s(]+)\s*{_LIST}", bare, re.I):
                    out.append((table, "FOREIGN_KEY", [c[1], f"{_columns(k[1])[0]}.{_columns(k[2])[0]}"]))
    return out


def _parse(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"table": a, "type": b, "fields": c} for a, b, c in parse_ddl(t)])


def keys_from_ddl(spark: SparkSession, files: dict[str, str], app: str = "app") -> DataFrame:
    """``constraint`` facts of DDL files given as database -> path."""
    ship_package(spark)
    parse, out = F.pandas_udf(_parse, KEYS), None
    for db, path in files.items():
        rows = spark.read.text(path, wholetext=True).select(F.explode(parse("value")).alias("k"))
        full = F.transform("k.fields", lambda f: F.when(F.col("k.type") != "FOREIGN_KEY", F.concat_ws(".", F.lit(db), F.col("k.table"), f)).when(F.contains(f, F.lit(".")), F.concat_ws(".", F.lit(db), f)).otherwise(F.concat_ws(".", F.lit(db), F.col("k.table"), f)))
        cid = F.concat(F.col("k.type"), F.lit(":"), F.array_join(full, ","))
        rows = rows.select(F.lit(app).alias("app"), cid.alias("cid"), F.col("k.type").alias("type"), full.alias("fields"), F.lit(False).alias("transitive"))
        out = rows if out is None else out.unionByName(rows)
    return out

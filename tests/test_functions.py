import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions import names, order, paths


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def of(column):
        return one.select(column.alias("v")).first()["v"]

    return of


LESS = [("t3", "t4", True), ("t4.t7", "t4.t10", True), ("t4", "t4.t1", True), ("t4.t8.t9", "t4.t8", False), ("t3", "itemID", False), ("itemID", "t3", True)]


@pytest.mark.parametrize("a, b, expected", LESS)
def test_less(value, a, b, expected):
    assert value(order.less(F.lit(a), F.lit(b))) is expected


def test_stamps_are_a_strict_order(spark):
    stamps = ["t0", "t1", "t1.t0", "t1.t2", "t2", "t10", "t999", "x"]
    df = spark.createDataFrame([(a, b) for a in stamps for b in stamps], "a string, b string")
    less = {(r.a, r.b): r.l for r in df.select("a", "b", order.less(F.col("a"), F.col("b")).alias("l")).collect()}
    real = [s for s in stamps if s != "x"]
    for a in real:
        assert not less[a, a]
        for b in real:
            assert a == b or less[a, b] != less[b, a]


@pytest.mark.parametrize("path, upper, last", [("_obj.A.B", "_obj.A", ".B"), ("_obj[*].A", "_obj[*]", ".A"), ("_obj", None, None)])
def test_upper_path(value, path, upper, last):
    assert value(paths.upper_path(F.lit(path))) == upper
    assert value(paths.last_segment(F.lit(path))) == last


def test_prefixes_are_raw_unless_segments_are_asked_for(value):
    a, b = F.lit("db.t.ID"), F.lit("db.t.IDCard")
    assert value(paths.is_prefix(a, b)) and not value(paths.is_prefix(a, b, segment_aware=True))
    assert value(paths.is_prefix(a, F.lit("db.t.ID.x"), segment_aware=True))
    assert not value(paths.is_prefix(a, a)) and value(paths.is_prefix(a, a, strict=False))
    assert value(paths.remainder(F.lit("notification"), F.lit("notification.PostID"))) == ".PostID"


TRACES = [
    ("MovieIdService.RegisterMovieId.t4", "t4", "_obj"),
    ("MovieIdService.RegisterMovieId.t4.MovieId", "t4", "_obj.MovieId"),
    ("S.M.t4.Casts[*].CastInfoID", "t4", "_obj.Casts[*].CastInfoID"),
    ("S.M.t17[*]", "t17", "_obj[*]"),
    ("S.M.t17[*].X", "t17", "_obj.X"),
]


@pytest.mark.parametrize("path, argument, objpath", TRACES)
def test_trace_paths(value, path, argument, objpath):
    assert value(paths.trace_argument(F.lit(path))) == argument
    assert value(paths.trace_object_path(F.lit(path))) == objpath


def test_names(value):
    short = names.short_function_path(F.lit("(*github.com/x/workflow/app.FooServiceImpl).Bar"))
    assert value(short) == "app.FooService.Bar"
    assert value(names.service_of(short)) == "FooService"
    assert value(names.method_of(short)) == "Bar"
    assert value(paths.field_name(F.lit("db.t.a.b"))) == "a.b"
    assert value(paths.field_name(F.lit("db.t"))) == "db.t"
    assert value(paths.insert_after_field(F.lit("db.t.f.x"), F.lit("[*]"))) == "db.t.f[*].x"
    assert value(names.bson_name(F.lit('bson:"_id,omitempty"'))) == "_id"
    assert value(names.bson_name(F.lit('json:"x"'))) is None
    assert value(names.edge_number(F.lit("Service.Method.t12"))) == 12
    assert value(names.edge_number(F.lit("Service"))) == -1
    assert value(names.dot_label(F.lit('a"b'))) == 'a\\"b'
    assert value(names.constraint_label(F.lit("FOREIGN_KEY"), F.array(F.lit("a"), F.lit("b")))) == "FOREIGN_KEY a REFERENCES b"
    assert value(names.operation_label(F.lit("read_many"))) == "read"
    assert value(names.strip_client(F.lit("user_db.client"))) == "user_db"
    assert value(names.string_literal(F.lit('"abc"'))) == "abc"
    assert value(paths.cache_namespace(F.lit("id:posts"))) == "posts" and value(paths.cache_namespace(F.lit("id"))) == "*"
    assert value(paths.schema_name(F.lit("db.items[*].x"))) == "items"
    assert value(paths.prepend_after_root(F.lit("_obj.x"), F.lit(".y"))) == "_obj.y.x"
    assert value(paths.cut_suffix(F.lit("_obj.x"), F.lit(".x"))) == "_obj"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=3), min_size=1, max_size=5))
def test_ancestors_are_all_upper_paths(spark, parts):
    path = ".".join(parts)
    found = spark.range(1).select(paths.ancestors(F.lit(path)).alias("v")).first()["v"]
    assert found == [".".join(parts[:i]) for i in range(1, len(parts))]

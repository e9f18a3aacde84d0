"""The stages against plain versions of themselves on the smallest tables."""

import re

import corpus_pipeline
from keelson.llm import packing, queries, secrets
from tests.llm.test_decontam import brute as hits
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_secrets import brute as spans


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == columns
        seen[name] = (before.collect(), docs.collect())
    text = lambda rows: {r.doc_id: r.text for r in rows}
    kept = {r.doc_id for r in queries.op1_quality_rules(spark, data).where("kept").collect()}
    assert set(text(seen["quality rules"][1])) == kept
    before, after = seen["n-gram Jaccard join"]
    assert set(text(after)) == {c for _, c, _ in classes([(r.doc_id, r.text) for r in before])}
    before, after = map(text, seen["benchmark decontamination"])
    for d, t in before.items():
        clean = hits(t, items)[1] == 0
        assert after[d] == t if clean else d not in after or hits(after[d], items)[1] == 0
    before, after = map(text, seen["secret scans"])
    assert set(before) == set(after)
    for d, t in before.items():
        assert (after[d] == t) == (not spans(t)) and not [s for s in spans(after[d]) if s[1] < len(secrets.BASE_RULES)]
    before, after = seen["best-fit packing"]
    coder = packing.word_ids(packing.tokenizer_path("word_bpe_49k.json"))
    assert sum(r.length for r in after) == sum(len(coder.encode(r.text.encode())) // 4 + 1 for r in before)
    assert all(r.n_chars == len(r.text) for r in before)


def test_odd_rows_and_columns(spark, tables):
    letters = str.maketrans("0123456789", "aeioubdglm")
    words = lambda n, seed: " ".join(f"{100_000 * seed + i}".translate(letters) for i in range(n))
    long = words(40_000, 5) + " secret=abcdefgh"
    docs = [(1, words(200, 1), "a", 1, True, None), (1, words(200, 1), "a", 1, True, None), (2, words(200, 1), "b", 2, False, "x"), (None, words(150, 2), "c", 3, None, "y")]
    docs += [(3, None, None, None, None, None), (4, "", "d", 4, True, "z"), (5, "too short", "e", 5, True, "z"), (6, long, "f", 6, True, "z"), (7, words(90, 7), "g", 7, True, "z"), (7, words(90, 8), "g", 7, True, "z"), (8, "one two three four five six seven eight nine ten " + words(80, 9), "h", 8, True, "z")]
    schema = "doc_id long, text string, spans string, n_words int, kept boolean, LEAD_ID string"
    folder = tables(documents=(docs, schema), benchmark=([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string"))
    out, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, out, folder).write.parquet(f"{folder}/stage{i}")
        out = spark.read.parquet(f"{folder}/stage{i}")
        assert out.columns == docs_columns(schema)
        kept.append(sorted(((r.doc_id or 0), r.spans) for r in out.collect()))
    assert kept[1] == [(0, "c"), (1, "a"), (6, "f"), (7, "g"), (7, "g"), (8, "h")]
    last = {r.spans: r for r in out.collect()}
    assert last["f"].text == words(40_000, 5) + " [secret]" and not last["h"].text.startswith("one") and last["a"].n_words == 1 and last["f"].LEAD_ID == "z"
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {None, 1, 6, 7, 8}
    empty = tables(documents=([], schema), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).collect() == []


def docs_columns(schema):
    return [x.split()[0] for x in schema.split(", ")]


def test_run_is_its_stages(spark, data):
    packed = corpus_pipeline.run(spark, data)
    assert packed.count() > 0 and {"sequence_id", "offset"} <= set(packed.columns)
    assert len(corpus_pipeline.STAGES) == 5 and not re.search(r"limit\(|sample\(", open(corpus_pipeline.__file__).read())


def test_odd_column_names(spark, tmp_path):
    """Dots, backticks, blanks and arrays of maps in further columns, in every operator that keeps columns."""
    from keelson.llm import decontam, pii, quality, secrets, substring

    prose = "\n".join(" ".join("".join(chr(97 + (i * k * k + 7 * j + k) % 26) for k in range(3 + (i + j) % 5)) for i in range(12)) + "." for j in range(12)) + " token=abcdefgh"
    docs = spark.createDataFrame([(1, prose, 0.5, "q", [{"k": 1}], 3), (2, prose + " end.", 0.5, "q", [{"k": 2}], 4)], "doc_id long, text string, `a.b` double, `back``tick` string, `m m` array<map<string,int>>, `A` int")
    bench = spark.createDataFrame([("i", " ".join(prose.split()[5:16]))], "item_id string, text string")
    found, names = decontam.find_contamination(docs, bench)
    assert found.columns[: len(docs.columns)] == docs.columns and [r[names["n_words"]] > 0 for r in found.collect()] == [True, True]
    small, names = decontam.find_contamination(docs, bench.union(bench), phrase_bytes=1)
    assert small.count() == 2
    assert decontam.remove_contamination(docs, bench).collect()[0]["back`tick"] == "q" and decontam.remove_contamination(docs, bench.union(bench), phrase_bytes=1).count() == 2
    assert substring.dedup(docs)[0].columns[: len(docs.columns)] == docs.columns and substring.dedup(docs)[0].count() == 2
    assert quality.with_counts(docs).count() == 2
    spotted, spans = secrets.find_secrets(docs)
    assert [len(r[spans]) for r in spotted.collect()] == [1, 1] and spotted.columns == [*docs.columns, spans]
    assert pii.mask_personal(docs).columns == docs.columns
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage_of in corpus_pipeline.STAGES[:4]:
        out = stage_of(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r["m m"] in ([{"k": 1}], [{"k": 2}]) for r in out.collect())

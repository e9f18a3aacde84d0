import random
import re
import time

from pyspark.sql import functions as F

from keelson.llm import pii, queries

#: The patterns as plain regular expressions, the group that is the span, and the test of it.
DIGITS = lambda s: re.sub(r"[^0-9]", "", s)
CUES = "|".join(sorted(pii.ACCOUNT_CUES))
PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", 0, lambda s: 14 <= len(DIGITS(s)) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(DIGITS(s)[::-1])) % 10 == 0),
    (r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda s: 10 <= len(DIGITS(s)) <= 15),
    (rf"[A-Za-z][{pii.SCHEME}]*://[{pii.USER}]+@[A-Za-z0-9.-]+", 0, lambda s: True),
    (f"(?:{CUES}){pii.ACCOUNT_TAIL}", 1, lambda s: 6 <= len(DIGITS(s)) <= 20),
    (f"(?:iban|Iban|IBAN){pii.IBAN_TAIL}", 1, lambda s: int("".join(str(int(c, 36)) for c in (s.replace(" ", "")[4:] + s.replace(" ", "")[:4]))) % 97 == 1),
]


def brute(text):
    return sorted((m.start(g), i, m.end(g)) for i, (p, g, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m[g]))


TEXTS = [
    None, "", "a@b.c@d.e f@g", "x@a@b.co.uk. é漢 me.you+1@mail-7.example.com.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 1.2.3 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12  34",
    "+1 (017) 555-7713 +49 30 1234567. +1 +12((( ++1234567890 +123456789012345678", "https://bob:pw@host.de/x ftp://a@b http://ftp://u@v 9x+y://z@w", "account no. 1234 5678 acct#AB123456 Passport: C01X00T47 ACCOUNT 12",
    "IBAN: GB82 WEST 1234 5698 7654 32 iban DE89370400440532013000 Iban DE88370400440532013000", "account IBAN12 3456 789", "@@@ a@.b a@b..c -@-.-", "1.1.1.1.", "1-2 3-4567890123452",
]


def test_texts():
    for t in TEXTS:
        assert pii.scan_text(t) == brute(t), t
    assert {pii.KINDS[k] for t in TEXTS for _, k, _ in pii.scan_text(t)} == set(pii.KINDS)


def test_random_texts():
    rng = random.Random(3)
    parts = ["@", ".", "-", " ", "+", "(", ")", "a", "B", "é", "1", "9", "25", "0", "://", "account", "iban", "IBAN ", "GB82WEST12345698765432", "4111111111111111", ":", "#", "no", "x@y.z", "1.2.3.4", "_", "%", "/"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 30)))
        assert pii.scan_text(t) == brute(t), t


def test_linear_in_the_text():
    began = time.perf_counter()
    for t in ("@" * 300_000, "a" * 300_000 + "@" + "b" * 300_000, "1" * 300_000 + ".2.3.4", "1.2" * 200_000, "+1" + "(" * 300_000, "1 " * 300_000, "a://" * 100_000, "account no. " * 50_000):
        pii.scan_text(t)
    assert time.perf_counter() - began < 20


def test_spark_odd_rows_and_names(spark, odd_docs):
    rows = [(i, t, {"k": [1]}, "own") for i, t in [*odd_docs, *enumerate(TEXTS)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,array<int>>, spans string")
    found, name = pii.find_personal(docs)
    assert name == "spans_2" and found.columns == [*docs.columns, "spans_2"] and found.count() == len(rows)
    for r in found.collect():
        assert [(s["start"], s["rank"], s["end"]) for s in r[name]] == brute(r["text"]) and r["spans"] == "own" and r["a.b"] == {"k": [1]}
    clean = pii.mask_personal(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert brute(r["text"]) == [] or r["text"] is None
    assert pii.mask_text("me@x.de, é1.2.3.4") == "[email], é[ip]" and pii.mask_text(None) is None and pii.mask_text("clean") == "clean"
    odd = docs.withColumnsRenamed({"a.b": "back`tick", "spans": "TEXT "})
    assert pii.find_personal(odd)[0].columns == ["doc_id", "text", "back`tick", "TEXT ", "spans"]


def test_query_on_empty_and_odd_tables(spark, tables, odd_docs):
    assert queries.op12_pii_anchors(spark, tables(documents=([], "doc_id long, text string"))).collect() == []
    out = queries.op12_pii_anchors(spark, tables(documents=([*odd_docs, (9, "é a@b.cd 1.2.3.4")], "doc_id long, text string")))
    r = out.where("doc_id = 9").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 0, "email:2:8,ip:9:16")
    assert out.where(F.col("text").isNull() if "text" in out.columns else F.lit(False)).count() == 0 and out.count() == len(odd_docs) + 1

"""The thin queries of this subpackage and their DuckDB SQL.

Each query derives its digest columns from what its operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import chat, decontam, jaccard, negatives, packing, pii, quality, repair, secrets, substring, toxicity, urlfilter, warc
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, base test and the label model's verdict for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    names = quality.added_columns(docs.columns)
    counted = stage(quality.with_counts(docs).drop("text"), "quality-counts")
    judged = quality.judge(counted, quality.learn(counted, names), names)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover, and the items they belong to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct("items"))
    ids = F.array_join(items, ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a network fitted to the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net, share = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, net, share)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, found through the capture index and read back from the archives."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write_archive(pages)
    keys = pages.select(warc.surt_key(F.col("url")).alias("surt"), F.col("page_id").cast("long"))
    return archive.read(archive.lookup(keys)).drop("payload")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links (Jaccard of word 5-grams of 0.8 or more) of every document."""
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 20 words cover, and a digest of what is left."""
    kept, _ = substring.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Fixed values of the query.
URL_RULES = (
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: A conversation that the query adds; fixed values.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
CONTROL_TURNS = ((-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted windows of each conversation hold, read back from them."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    windows = chat.format_chats(turns)
    back = windows.select(
        "conv_id", "block", "nth", F.length("formatted").alias("chars"),
        chat.read_turns(F.col("formatted"), F.col("n_context")).alias("turns"), chat.read_targets(F.col("formatted"), F.col("loss")).alias("targets"),
    )
    read = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = F.array_sort(F.collect_list(F.struct("block", "nth", F.size("turns").alias("n"), F.array_join(read, "").alias("said"), "targets")))
    convs = back.groupBy("conv_id").agg(parts.alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    said, loss = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.targets"), "")
    return convs.select(
        "conv_id", F.aggregate(F.col("w.n"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: counts and digest of the base kinds, and all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, spans = secrets.find_secrets(docs)
    base = F.filter(F.col(spans), lambda s: s["rank"] < len(secrets.BASE_RULES))
    kinds = F.transform(F.col(spans), lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_string(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_string(F.col(spans)).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 100) and positive."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return negatives.mine(usable, F.col("vec_id") % 100 == 0)


def op12_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base kinds, and all spans."""
    found, spans = pii.find_personal(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(F.col(spans), lambda s: s["rank"] < len(pii.BASE_KINDS))
    kinds = F.transform(F.col(spans), lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_string(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_string(F.col(spans)).alias("spans"))


def damage(turns: DataFrame) -> DataFrame:
    """Turns with the faults that the query plants by the checksum of their key; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that repair it, and a digest of what they leave."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, kept = repair.repair(damage(turns))
    lines = F.array_sort(F.collect_list(F.struct("piece", "place", F.concat_ws(":", "role", "text").alias("line"))))
    digests = kept.groupBy("conv_id").agg(lines.alias("lines")).select(F.struct("conv_id").alias("conv"), F.array_join("lines.line", "\n").alias("repaired"))
    everyone = turns.select(F.struct("conv_id").alias("conv")).distinct()
    joined = everyone.join(audits.withColumn("conv", F.struct("conv_id")).drop("conv_id"), "conv", "left").join(digests, "conv", "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_warc_index": op4_warc_index,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_secret_scans": op9_secret_scans,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pii_anchors": op12_pii_anchors,
    "op13_structure_repair": op13_structure_repair,
}


def _secret_sql() -> str:
    """Spans by gap and match lengths: a match starts where all earlier gaps and matches and its own gap end."""
    found = []
    for i, r in enumerate(secrets.RULES):
        whole = f"(?s)(.*?)({r.pattern})".replace("'", "''")
        group = lambda g, w=whole: f"unnest(regexp_extract_all(text, '{w}', {g}))"
        found.append(f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, {group(1)} AS gap, {group(2)} AS hit, {group(2 + r.group)} AS tested, unnest(range(length(regexp_extract_all(text, '{whole}', 1)))) AS i FROM d")
    base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({" UNION ALL ".join(found)}),
        placed AS (
            SELECT *, coalesce(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS s FROM m
        ),
        sp AS (SELECT rid, rank, kind, s, kind || ':' || s || ':' || (s + length(hit)) AS span FROM placed WHERE length(tested) >= least),
        g AS (
            SELECT rid, {counts}, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {base}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM sp GROUP BY rid
        )
        SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)
    """


def _chat_sql(b: chat.Budget = chat.Budget()) -> str:
    """The same windows from plain prefix sums; their length is that of their turns and marks."""
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    esc = lambda x: f"length(replace(replace({x}, '\\', '\\\\'), '<|', '<\\|'))"
    tokens = f"(len(regexp_extract_all(text, '{chat.TOKEN}')) + {chat.TURN_TOKENS})"
    control = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROL_TURNS)
    return f"""
        WITH RECURSIVE d AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES {control}) v(conv_id, turn, role, text)
        ),
        k AS (
            SELECT *, {tokens} AS tokens, {esc('role')} + {esc('text')} + {marks} AS chars,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
        ),
        s AS (SELECT conv_id, tokens AS st, chars AS sc FROM k WHERE i = 1 AND role = 'system'),
        o AS (
            SELECT k.*, greatest({b.window - b.history} - coalesce(st, 0), {b.least_room}) AS room,
                   coalesce(sum(tokens) OVER (PARTITION BY k.conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
            FROM k LEFT JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id WHERE NOT (i = 1 AND role = 'system')
        ),
        p AS (SELECT *, a // (room * {chat.BLOCK_ROOMS}) AS block FROM o),
        -- Inside a block, the first turn that passes the room of a window starts the next one.
        w AS (
            SELECT conv_id, block, room, min(a) AS start FROM p GROUP BY ALL
            UNION ALL
            SELECT w.conv_id, w.block, w.room, (SELECT min(a) FROM p WHERE p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.block = w.block AND p.a > w.start AND p.a + p.tokens - w.start > w.room) AS next
            FROM w WHERE next IS NOT NULL
        ),
        h AS (
            SELECT w.conv_id, sum(p.chars) AS hist FROM w JOIN p
              ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND p.a + p.tokens <= w.start AND p.a >= w.start - {b.history} GROUP BY w.conv_id
        ),
        u AS (SELECT conv_id, sum(chars) AS own FROM p GROUP BY conv_id),
        n AS (SELECT w.conv_id, count(*) AS windows, any_value(own) AS own FROM w JOIN u ON w.conv_id IS NOT DISTINCT FROM u.conv_id GROUP BY w.conv_id),
        c AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM k GROUP BY conv_id
        )
        SELECT c.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(coalesce(own, 0) + coalesce(hist, 0) + coalesce(sc, 0) * greatest(coalesce(windows, 1), 1) AS BIGINT) AS formatted_chars
        FROM c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
               LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
    """


#: Words are numbered per document; a window's words in a row are compared as one string.
_DECONTAMINATION_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
    words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid),
    items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY rid)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


_WARC_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM t
"""


_SUBSTRING_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
    cut AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
    words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN cut USING (doc_id, j) GROUP BY doc_id),
    gone AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
_JACCARD_SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 10 * k >= 8 * (x.n + y.n - k)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(k, 0) AS n_links
    FROM d LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON doc_id = r.a LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON doc_id = l.a
"""


#: Scores of anchors with all rows; 6 positives and their ranges follow from them.
_NEGATIVES_SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b AS p, score AS ps FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
    n AS (SELECT p.a, p.p, s.b, ps, score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, b) AS k FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps)
    SELECT a AS anchor_id, p AS positive_id, CAST(k AS INT) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE k <= 10
"""


def _pii_sql() -> str:
    """Spans by gap and match lengths, as for secrets; a span is the last group of its match."""
    count = "length(regexp_replace(hit, '[^0-9]', '', 'g'))"
    digits = "[CAST(c AS INT) FOR c IN string_split(regexp_replace(hit, '[^0-9]', '', 'g'), '')]"
    doubled = f"list_transform(list_reverse({digits}), lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)"
    part = lambda i: f"length(ltrim(split_part(hit, '.', {i}), '0')) <= 3 AND CAST(coalesce(nullif(right(ltrim(split_part(hit, '.', {i}), '0'), 3), ''), '0') AS INT) <= 255"
    flat = "replace(hit, ' ', '')"
    values = f"[CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END FOR c IN string_split(substr({flat}, 5) || left({flat}, 4), '')]"
    mod = f"list_reduce(list_prepend(0, {values}), lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
    cues = "|".join(sorted(pii.ACCOUNT_CUES))
    kinds = (
        (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true"), (r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", " AND ".join(part(i) for i in range(1, 5))),
        (r"([0-9](?:[\x20-]?[0-9])+)", f"{count} BETWEEN 14 AND 19 AND list_sum({doubled}) % 10 = 0"), (r"(\+[0-9][\x20().0-9-]+[0-9])", f"{count} BETWEEN 10 AND 15"),
        (rf"([A-Za-z][{pii.SCHEME}]*://[{pii.USER}]+@[A-Za-z0-9.-]+)", "true"), (f"(?:{cues}){pii.ACCOUNT_TAIL}", f"{count} BETWEEN 6 AND 20"), (f"(?:iban|Iban|IBAN){pii.IBAN_TAIL}", f"{mod} = 1"),
    )
    found = []
    for i, ((pattern, _), kind) in enumerate(zip(kinds, pii.KINDS, strict=True)):
        whole = f"(?s)(.*?)({pattern})".replace("'", "''")
        group = lambda g, w=whole: f"unnest(regexp_extract_all(text, '{w}', {g}))"
        found.append(f"SELECT rid, {i} AS rank, '{kind}' AS kind, {group(1)} AS gap, {group(2)} AS matched, {group(3)} AS hit, unnest(range(length(regexp_extract_all(text, '{whole}', 1)))) AS i FROM d")
    test = " ".join(f"WHEN {i} THEN {ok}" for i, (_, ok) in enumerate(kinds))
    base = len(pii.BASE_KINDS)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({" UNION ALL ".join(found)}),
        placed AS (SELECT *, sum(length(gap) + length(matched)) OVER (PARTITION BY rid, rank ORDER BY i) AS e FROM m),
        sp AS (SELECT rid, rank, kind, e - length(hit) AS s, kind || ':' || (e - length(hit)) || ':' || e AS span FROM placed WHERE CASE rank {test} END),
        g AS (
            SELECT rid, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(pii.BASE_KINDS))}, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {base}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM sp GROUP BY rid
        )
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
    """


def _repair_sql() -> str:
    """The fold as a recursion over turns: each state is its cost, its audit and the text so far."""
    state = "STRUCT(c BIGINT, k VARCHAR, t VARCHAR)"
    plus = lambda s, c, k, t="''": f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {c}, 'k': {s}.k || '{k}', 't': {s}.t || {t}}} END"
    best = lambda *x: f"list_sort(list_filter([{', '.join(x)}], lambda z: z IS NOT NULL))[1]"
    stays = lambda cond, s, c, k, t: f"CASE WHEN {cond} THEN {plus(s, c, k, t)} END"
    own, said = "chr(10) || role || ':' || text", lambda r: f"chr(10) || '{r}:' || text"
    insert = lambda s, r: plus(s, repair.INSERT, "I", f"chr(10) || '{r}:'")
    user = best("s2", *(insert(s, "user") for s in ("s0", "s1", "s3")))
    cut = f"{repair.TRUNCATED} * CAST(fault = 'truncated' AS INT)"
    gone = lambda s: plus(s, repair.DELETE, "D")
    return rf"""
        WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, [ascii(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')] AS b FROM conversations),
        x AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, y: xor(c // 256, tab[xor(c % 256, y) + 1])), 4294967295) % 20 AS f FROM k, tab),
        d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM x WHERE f <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
        g AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND concat(prev, '|', ini) NOT IN ('s|u', 'u|a', 'a|u')) AS illegal FROM g GROUP BY conv_id),
        r AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'k': '', 't': ''}} AS {state}) AS s0, CAST(NULL AS {state}) AS s1, CAST(NULL AS {state}) AS s2, CAST(NULL AS {state}) AS s3 FROM n
            UNION ALL
            SELECT conv_id, i, CAST({gone("s0")} AS {state}), CAST({best(gone("s1"), stays("stay AND ini = 's'", "s0", cut, "K", own))} AS {state}),
                   CAST({best(gone("u"), stays("stay AND ini = 'u'", "b", cut, "K", own), stays("stay", "b", f"{repair.REROLE} + {cut}", "R", said("user")))} AS {state}),
                   CAST({best(gone("a"), stays("stay AND ini = 'a'", "u", cut, "K", own), stays("stay", "u", f"{repair.REROLE} + {cut}", "R", said("assistant")))} AS {state})
            FROM (SELECT *, {best("s3", insert("u", "assistant"))} AS a, {best("s0", "s1", "a")} AS b FROM (
                SELECT r.conv_id, g.i, role, text, ini, fault, fault NOT IN ('blank', 'duplicate') AS stay, s0, s1, s2, s3, {user} AS u FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = r.i + 1))
        ),
        z AS (SELECT conv_id, i, {best("s0", "s3", insert("u", "assistant"))} AS s FROM (SELECT *, {user} AS u FROM r))
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost,
               coalesce(s.k, '') AS audit, sha256(coalesce(substr(s.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = n.n
    """


ORACLE = {
    "op11_hard_negatives": _NEGATIVES_SQL,
    "op12_pii_anchors": _pii_sql(),
    "op13_structure_repair": _repair_sql(),
    "op5_ngram_jaccard_join": _JACCARD_SQL,
    "op6_substring_dedup": _SUBSTRING_SQL,
    "op4_warc_index": _WARC_SQL,
    "op2_benchmark_decontamination": _DECONTAMINATION_SQL,
    "op8_chat_formatting": _chat_sql(),
    "op9_secret_scans": _secret_sql(),
    "op7_url_filters": r"""
        WITH cut AS (
            SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^?#]*)', 1), '') AS tail FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(CASE WHEN strpos(tail, '/') > 0 THEN substr(tail, 1, strpos(tail, '/') - 1) ELSE tail END,
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN strpos(tail, '/') > 0 THEN substr(tail, strpos(tail, '/')) ELSE '' END AS path
            FROM cut
        ), rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), fits AS (
            SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
            FROM parts JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
    """,
}

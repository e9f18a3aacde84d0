import hashlib
import itertools
import random
import re
import zlib


from keelson.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, lines) by trying all edits; inserts stand before turns or at the end."""
    def after(state, who):
        return {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(who)

    layer = {0: [(0, "", ())]}  # every audit, not only the least of a state

    def inserted(layer):
        out = {s: list(v) for s, v in layer.items()}
        for _ in range(2):
            for s, v in list(out.items()):
                who, to = ("assistant", 3) if s == 2 else ("user", 2)
                out.setdefault(to, []).extend((c + 3, k + "I", t + (f"{who}:",)) for c, k, t in v if (c + 3, k + "I", t + (f"{who}:",)) not in out.get(to, []))
        return {s: sorted(set(v))[:60] for s, v in out.items()}

    for (role, text), fault in zip(rows, bad, strict=True):
        new: dict = {}
        for s, v in inserted(layer).items():
            for c, k, t in v:
                new.setdefault(s, []).append((c + 4, k + "D", t))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 3 * (fault == "truncated")
                if (to := after(s, role[:1])) is not None:
                    new.setdefault(to, []).append((c + extra, k + "K", t + (f"{role}:{text}",)))
                for who in ("user", "assistant"):
                    if (to := after(s, who[0])) is not None:
                        new.setdefault(to, []).append((c + extra + 3, k + "R", t + (f"{who}:{text}",)))
        layer = {s: sorted(set(v))[:60] for s, v in new.items()}
    end = inserted(layer)
    return min(x for s in (0, 3) for x in end.get(s, []))


def brute(turns):
    """Everything about each conversation, from rows (conv_id, turn, role, text)."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    turns = [(c, n, " " if r is None else r, " " if t is None else t) for c, n, r, t in turns]
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=key)
        rows = [t[2:] for t in own]
        bad, numbers = faults(rows), {t[1] for t in own if t[1] is not None}
        cost, audit, lines = cheapest(rows, bad)
        illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(rows))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))
    return out


def repaired(spark, rows):
    audits, kept = repair.repair(spark.createDataFrame(rows, SCHEMA))
    lines: dict = {}
    for r in sorted(kept.collect(), key=lambda r: (r.piece, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    found = audits.collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: (*r[1:], "\n".join(lines.get(r.conv_id, []))) for r in found}


def made(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "s", "", None]
    texts = ["Yes.", "no", "Why?", "", " \t", "a\nb!", "é漢.", None, "x. "]
    for i in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.7 else rng.choice(roles)
        text = f"{rng.choice(texts)} {i}." if rng.random() < 0.6 else rng.choice(texts)
        yield (conv, rng.choice([i, i, i, i + 2, 1, None]), role, text)


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = [t for conv in range(150) for t in made(rng, conv, rng.randint(1, 9))]
    rows += [(None, 0, "user", "hi."), (None, 0, "user", "hi."), (None, None, "assistant", "x")]
    assert repaired(spark, rows) == brute(rows)


def test_pieces_compose(spark, monkeypatch):
    """The same rows when a piece holds 4 turns and 2 pieces are composed at once."""
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    monkeypatch.setattr(repair, "SPAN_BITS", 1)
    rng = random.Random(12)
    rows = [t for conv in range(12) for t in made(rng, conv, rng.randint(1, 60))] + list(made(rng, 99, 150))
    assert repaired(spark, rows) == brute(rows)


def test_long_conversation_and_repeated_rows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(6000)] + [(2, 5, "user", "again.")] * 3000
    got = repaired(spark, rows)
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 6000) and got[1][7].count("\n") == 5999
    assert got[2] == (0, 0, 2999, 0, 2999, 4 * 2999 + 3, "D" * 2999 + "K" + "I", "user:again.\nassistant:") or got[2][5] == 4 * 2999 + 3


def test_query_against_brute_force(spark, tables):
    rng = random.Random(13)
    rows = [t for conv in range(80) for t in made(rng, conv, rng.randint(1, 9))] + [(None, None, None, None), (500, 1, "user", "y" * 100_000 + ".")]
    crc = lambda c, n: zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
    hurt = []
    for c, n, r, t in rows:
        f, r, t = crc(c, n), " " if r is None else r, " " if t is None else t
        t = "" if f == 1 else re.sub("[.!?]", "", t) if f == 2 else t
        hurt += [(c, n, "user" if f == 4 else r, t)] * {0: 0, 3: 2}.get(f, 1)
    want = {c: (*v[:7], hashlib.sha256(v[7].encode()).hexdigest()) for c, v in brute(hurt).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    folder = tables(conversations=([(*r, "x") for r in rows], SCHEMA + ", conv string"))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_structure_repair(spark, folder).collect()}
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert queries.op13_structure_repair(spark, tables(conversations=([], SCHEMA))).collect() == []


def test_plan_has_no_python(spark, data):
    plan = queries.op13_structure_repair(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))

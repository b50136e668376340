"""Repair against all edit strings tried one after the other, and against a plain dynamic programme."""

import hashlib
import random
import re
import zlib
from itertools import product

from pyspark.sql import functions as F

from saldo.llm import role_grammar as G
from saldo.llm.conversation_repair import COUNTS, damage, repair_conversations, with_digest

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def tried(classes):
    """Least (cost, audit) over all ways, with two inserts at most in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    options = [[("D", "", 2)] if c == "x" else [("D", "", 2), *([("K", c.lower(), 5 * (c.isupper() or c == "+"))] if c not in "-+" else []),
                                               *[("R", t, 1 + 5 * (c.isupper() or c == "+")) for t in "ua"]] for c in classes]
    for edits in product(*options):
        for ins in product(gaps, repeat=len(classes) + 1):
            roles = ins[0] + "".join(e[1] + g for e, g in zip(edits, ins[1:], strict=True))
            cost = 5 * sum(map(len, ins)) + sum(e[2] for e in edits)
            if (best is None or cost <= best[0]) and GRAMMAR.fullmatch(roles):
                audit = "I" * len(ins[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, ins[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_parse_against_all_edits():
    for n in range(4):
        for classes in product(G.ANY if n < 3 else "suaU-x", repeat=n):
            assert G.best(G.parse("".join(classes))) == tried(classes), classes


def test_pieces_give_what_the_whole_gives(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        rows = "".join(rng.choices(G.ANY, k=rng.randrange(1, 40)))
        whole = G.best(G.parse(rows))
        monkeypatch.setattr(G, "PIECE", rng.randrange(1, 9))
        assert G.best(G.parse_long(rows)) == whole
        sizes = [len(rows) // 3, 0, len(rows) - len(rows) // 3]
        assert "".join(G.pieces_of(whole[1], sizes)) == whole[1]


def plain(rows):
    """Results from the damaged rows of one conversation, by a table over places and grammar states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, classes, n = set(), [], dict.fromkeys(COUNTS, 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        c = role[:1] if role[:1] in tuple("sua") else "-"
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        classes.append((c, fault))
    n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {r[0] for r in rows if r[0] is not None}
    n["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    step = {("N", "s"): "S", ("N", "u"): "O", ("S", "u"): "O", ("C", "u"): "O", ("O", "a"): "C"}

    def inserted(table):
        for _ in range(4):
            for (x, t), y in step.items():
                if t != "s" and x in table:
                    cost, audit, out = table[x]
                    new = (cost + 5, audit + "I", [*out, ("user" if t == "u" else "assistant", "")])
                    table[y] = min(table.get(y, new), new)
        return table

    table = inserted({"N": (0, "", [])})
    for (c, fault), (_, role, text) in zip(classes, rows, strict=True):
        new = {}
        for x, (cost, audit, out) in table.items():
            ways = [(x, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways += [(y, (cost + more, audit + "K", [*out, (role, text)])) for (z, t), y in step.items() if z == x and t == c]
                ways += [(y, (cost + more + 1, audit + "R", [*out, ("user" if t == "u" else "assistant", text)])) for (z, t), y in step.items() if z == x and t != "s"]
            for y, way in ways:
                new[y] = min(new.get(y, way), way)
        table = inserted(new)
    cost, audit, out = min(table[x] for x in "NC" if x in table)
    return n | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def check(spark, rows, extra=False, partitions=4):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumn("place", F.lit(1)).withColumn("class", F.lit("x")).withColumn("dropped", F.lit(True)).withColumn("audit", F.lit("q"))
    df = damage(df)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 4).lower())
    try:
        got = [r.asDict() for r in with_digest(repair_conversations(df)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [{"conv_id": k} | plain(v) for k, v in damaged(rows).items()]
    order = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


def chats(rng, conversations, most):
    texts = ["Yes.", "No", "Why? ", "\t", "", "Fine!\n", "so\x0b.", "Ünï.", None, "a: b.", "Tell me.\n\nNow."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "assistant\n"]
    return [(c, t if rng.random() < 0.95 else None, roles[(t % 2) if rng.random() < 0.8 else rng.randrange(len(roles))], rng.choice(texts) if rng.random() < 0.5 else f"word {rng.random()}.")
            for c in range(conversations) for t in range(rng.randrange(1, most))]


def test_against_a_plain_table(spark):
    rng = random.Random(3)
    rows = chats(rng, 120, 12) + [(None, t, "user", "Hi.") for t in range(5)] + [(500, 3, "user", "Same."), (500, 3, "user", "Same."), (500, 3, "assistant", "Other.")]
    rng.shuffle(rows)
    assert len(check(spark, rows, extra=True)) == 122


def test_a_hot_conversation_spans_partitions(spark):
    rng = random.Random(4)
    hot = [(7, t, r, x) for _, t, r, x in chats(rng, 1, 3)] + [(7, t, rng.choice(["user", "assistant", "system"]), f"{rng.random()}{rng.choice('.!,')}") for t in range(3000)]
    rows = hot + chats(rng, 40, 6)
    assert len(check(spark, rows, partitions=9)) >= 40
    runs = repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert runs.filter("part is not null").count() >= 2


def test_long_texts_and_empty_tables(spark):
    check(spark, [(1, 0, "user", "x. " * 200_000), (1, 1, "assistant", "y" * 300_000 + "."), (2, 0, "user", " " * 300_000)])
    assert with_digest(repair_conversations(damage(spark.createDataFrame([], SCHEMA)))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert check(spark, [(gone, 0, "user", "Hi.")])[0]["audit"] == ""

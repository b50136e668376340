"""Conversation structure repair: faults of turns, and the cheapest edits that give every conversation a legal order of roles.

Rows are dealt by ranges of (conversation, turn), so that a conversation may span any number of partitions: each parses its runs by the
role grammar, from every symbol where a run doesn't begin its conversation; the few runs at the edges of partitions are joined afterwards.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm import role_grammar as G
from saldo.llm.common import cut

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LARGEST = 2**63 - 1
#: ASCII white space, and what a whole text ends with.
SPACE, STOPS = " \t\n\x0b\f\r", (".", "!", "?")
LEGAL = ("su", "ua", "au")


def damage(turns: DataFrame) -> DataFrame:
    """Damages rows by crc32 of `conv_id:turn` modulo 20: 0 drops a row (it stays under the flag `dropped`, to name its conversation), 1 empties
    its text, 2 takes its full stops, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text, role = named("text"), named("role")
    src = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), (kind == 0).alias("dropped"),
                       F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return src.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds `class`, a row's class in the grammar: `x` if it is blank, `y` if its role and text stand on an earlier turn of its conversation.
    Copies on one turn get none: the ordered pass sees them next to each other.

    Only keys on several turns are joined back, by digests, so that a key's rows needn't meet in one task."""
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    src = turns.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("place", place)
    seen = src.filter("not dropped").groupBy("conv", "said").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first != last").select("conv", "said", "first")
    initial, trimmed = F.substring("role", 1, 1), F.rtrim("text", F.lit(SPACE))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    cls = F.when(trimmed == "", "x").when(F.col("place") > F.col("first"), "y").when(F.substring(trimmed, -1, 1).isin(*STOPS), kind).otherwise(F.translate(kind, "sua-", "SUA+"))
    return src.join(seen, ["conv", "said"], "left").select("conv", "conv_id", "place", "turn", "role", "text", cls.alias("class"), "dropped")


class _Run:
    """Neighbouring rows of one conversation within a partition."""

    def __init__(self, conv: str, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.rows, self.classes, self.last = [], [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str, cls: str) -> None:
        now = (turn, role, text)
        if cls == "x":
            self.blank += 1
        elif cls == "y" or now == self.last:
            self.duplicate += 1
            cls = "x"
        elif cls in "SUA+":
            self.truncated += 1
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in LEGAL
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append((role, text))
        self.classes.append("x" if cls == "y" else cls)
        self.last = now

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}

    def whole(self) -> dict:
        cost, audit = G.best(G.parse_long("".join(self.classes)))
        gaps = 0 if self.low is None else min(LARGEST, self.high - self.low + 1 - self.distinct)
        turns = G.apply(audit, self.rows, 0, G.turns_left(audit) % 2 == 1)
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts(), "cost": cost, "audit": audit, "turns": turns, "conv": None, "part": None, "edge": None}

    def piece(self, part: int) -> dict:
        rows = "".join(self.classes)
        edge = {**self.counts(), "charts": {x: G.parse_long(rows, x) for x in G.SYMBOLS}, "size": len(rows), "distinct": self.distinct, "low": self.low, "high": self.high,
                "initials": [self.rows[0][0][:1], self.rows[-1][0][:1]] if rows else None}
        return {"conv_id": self.conv_id, **dict.fromkeys(COUNTS), "audit": None, "turns": self.rows, "conv": self.conv, "part": part, "edge": json.dumps(edge)}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    told = [r | {"turns": [{"role": a, "text": b} for a, b in r["turns"]]} for r in rows]
    return pa.RecordBatch.from_pylist(told, schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    return pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("turns", pa.list_(turn)), ("conv", pa.string()), ("part", pa.int32()), ("edge", pa.string())])


def _runs(batches):
    """Runs of a partition's sorted rows; the first and the last may go on in other partitions."""
    run = None
    for b in batches:
        ids = b.column("conv_id")
        for i, (conv, turn, role, text, cls, dropped) in enumerate(zip(*[b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "class", "dropped")], strict=True)):
            if run is None or conv != run.conv:
                if run is not None:
                    yield run, ids.type
                run = _Run(conv, ids[i].as_py())
            if not dropped:
                run.add(turn, role, text, cls)
    if run is not None:
        yield run, ids.type


def _parse_runs(batches):
    """A row of results for each conversation inside the partition, a row of charts for each run at its edges, which may go on in other partitions."""
    from pyspark import TaskContext

    part, held, size, before, schema = TaskContext.get().partitionId(), [], 0, None, None

    def note(row):
        nonlocal held, size
        held.append(row)
        size += sum(len(a) + len(b) for a, b in row["turns"])
        if size > 1 << 22 or len(held) >= 4096:
            full, held, size = held, [], 0
            yield _arrow(full, schema)

    for k, (run, kind) in enumerate(_runs(batches)):
        schema = schema or _schema(kind)
        if before is not None:
            yield from note(before.piece(part) if k == 1 else before.whole())
        before = run
    if before is not None:
        yield from note(before.piece(part))
        if held:
            yield _arrow(held, schema)


def _join_edges(batches):
    """Per conversation at the edges, its counts and audit (from the charts of its runs, in order), and for each run the letters and
    the place at which its turns begin. Charts only: no text."""
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("letters", pa.string()), ("emitted", pa.int64()), ("system", pa.bool_())])

    def close(conv, runs):
        column, total, high, low, distinct, initial = None, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None, None, 0, None
        for _, e in runs:
            charts = {x: {y: tuple(v) for y, v in c.items()} for x, c in e["charts"].items()}
            column = charts["N"] if column is None else G.extend(column, charts)
            for c in total:
                total[c] += e[c]
            if e["initials"]:
                total["illegal"] += initial is not None and initial + e["initials"][0] not in LEGAL
                initial = e["initials"][1]
            if e["low"] is not None:
                distinct += e["distinct"] - (e["low"] == high)
                low, high = e["low"] if low is None else low, e["high"]
        cost, audit = G.best(column)
        gaps = 0 if low is None else min(LARGEST, high - low + 1 - distinct)
        emitted, system, out = 0, G.turns_left(audit) % 2 == 1, []
        for n, ((part, e), letters) in enumerate(zip(runs, G.pieces_of(audit, [e["size"] for _, e in runs]), strict=True)):
            out.append({"conv": conv, "part": part, "gaps": gaps, **total, "cost": cost, "audit": audit if n == 0 else None, "letters": letters, "emitted": emitted, "system": system})
            emitted += G.turns_left(letters)
        return pa.RecordBatch.from_pylist(out, schema=schema)

    now, runs = None, []
    for b in batches:
        for conv, part, edge in zip(*[b.column(c).to_pylist() for c in ("conv", "part", "edge")], strict=True):
            if runs and conv != now:
                yield close(now, runs)
                runs = []
            now = conv
            runs.append((part, json.loads(edge)))
    if runs:
        yield close(now, runs)


def _apply_edges(batches):
    """Repaired turns of each run at the edges."""
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            turns = G.apply(r["letters"], [(t["role"], t["text"]) for t in r["turns"]], r["emitted"], r["system"])
            kind = b.schema.field("conv_id").type
            yield _arrow([r | {"turns": turns, "edge": None}], _schema(kind))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Counts faults of every conversation and repairs it by its cheapest edits.

    Takes conv_id, turn, role, text and, if there is one, a flag `dropped` for rows that only name their conversation; other columns are
    ignored. Rows stand in the order of turn (nulls first), role, text; rows alike on one turn are duplicates of the first; null roles and
    texts count as one space, null ids are one conversation. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    the repaired `turns` (array of role and text). A conversation that spans partitions has a row for each `part` of its turns, in
    that order, and `conv` names it; its audit stands on the first of them. A conversation inside a partition has null in both.
    An empty table gives none; a conversation without rows has zeros and an empty audit.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit(""))
    src = with_faults(turns.select("conv_id", conv.alias("conv"), F.col("turn").cast("long"), space("role"), space("text"), dropped.alias("dropped")))
    keys = ["conv", "place", "role"]
    dealt = src.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    fields = f"conv_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns array<struct<role:string,text:string>>, conv string, part int, edge string"
    runs = cut(dealt.drop("place").mapInArrow(_parse_runs, fields))
    edges = runs.filter("edge is not null")
    told = cut(edges.select("conv", "part", "edge").repartition("conv").sortWithinPartitions("conv", "part")
               .mapInArrow(_join_edges, f"conv string, part int, {', '.join(f'{c} long' for c in COUNTS)}, audit string, letters string, emitted long, system boolean"))
    many = edges.select("conv_id", "turns", "conv", "part", "edge").join(told, ["conv", "part"]).mapInArrow(_apply_edges, fields)
    return runs.filter("edge is null").unionByName(many).drop("edge")


def _hash_parts(batches):
    """SHA-256 of the conversations that span partitions, whose parts come in order: one part is held at a time."""
    schema, now, first, sha = None, None, None, None

    def told():
        return pa.RecordBatch.from_pylist([{**first, "repaired_sha256": sha.hexdigest()}], schema=schema)

    for b in batches:
        if schema is None:
            schema = pa.schema([b.schema.field(c) for c in ("conv_id", *COUNTS, "audit")] + [("repaired_sha256", pa.string())])
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if sha is None or r["conv"] != now:
                if sha is not None:
                    yield told()
                now, sha, begun, first = r["conv"], hashlib.sha256(), False, {c: r[c] for c in schema.names[:-1]}
            if r["turns"]:
                sha.update(("\n" * begun + "\n".join(f"{t['role']}:{t['text']}" for t in r["turns"])).encode())
                begun = True
    if sha is not None:
        yield told()


def with_digest(repaired: DataFrame) -> DataFrame:
    """One row for each conversation, with the digest of its repaired `role:text` lines. A digest is sequential, so the parts of a
    conversation that spans partitions go through one task, one after the other."""
    columns = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    inner = repaired.filter("part is null").withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).select(*columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    parts = repaired.filter("part is not null").repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_hash_parts, kinds)
    return inner.unionByName(parts)

"""Error-correcting Earley parsing of role sequences.

The grammar of role initials is (s?(ua)+)?, written left-linear: N (nothing yet), S (a system turn), O (a pair is open), C (pairs
are complete). Each production that reads a role has variants that correct: rerole reads any row, insert reads none, and delete
lets a symbol span a row it doesn't read. As the grammar is left-linear, every item starts at the sequence's first row, so a column of
the chart holds a bounded number of items; each item keeps its least (cost, audit). Audits of one span differ before either ends
(all have the same letters for rows, and inserts cost), so the least of two parts is the least of the whole.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SYMBOLS, GOALS = "NSOC", "NC"
#: A row's class: its initial (`-`: none of the three), a capital (`+` for `-`) if it is truncated, `x` if it must go.
ANY = "sua-SUA+x"
PIECE = 1024


class Production(NamedTuple):
    head: str
    body: str  # a symbol, then the classes of the row it reads (none: an insert)
    cost: int
    letter: str


def _productions() -> list[Production]:
    out = []
    for head, before, role in (("S", "N", "s"), ("O", "N", "u"), ("O", "S", "u"), ("O", "C", "u"), ("C", "O", "a")):
        out.append(Production(head, before + role + role.upper(), KEEP, "K"))
        if role != "s":
            out += [Production(head, before + ANY[:-1], REROLE, "R"), Production(head, before, INSERT, "I")]
    return out + [Production(x, x + ANY, DELETE, "D") for x in SYMBOLS]


PRODUCTIONS = _productions()
READS = {c: {x: [p for p in PRODUCTIONS if p.body[0] == x and c in p.body[1:]] for x in SYMBOLS} for c in ANY}
INSERTS = {x: [p for p in PRODUCTIONS if p.body == x] for x in SYMBOLS}
Chart = dict[str, tuple[int, str]]


def _complete(column: Chart) -> Chart:
    """Completes the inserts of a column, cheapest items first, until nothing gets better."""
    agenda = sorted(column, key=column.get)
    while agenda:
        x = agenda.pop(0)
        cost, audit = column[x]
        for p in INSERTS[x]:
            new = (cost + p.cost, audit + p.letter)
            if p.head not in column or new < column[p.head]:
                column[p.head] = new
                agenda.append(p.head)
    return column


@lru_cache(maxsize=1 << 14)
def parse(rows: str, start: str = "N") -> Chart:
    """Last column of the chart of a sequence of row classes (at most PIECE of them) that the symbol `start` stands before."""
    column = _complete({start: (0, "")})
    for c in rows:
        scanned: Chart = {}
        for x, (cost, audit) in column.items():
            for p in READS[c][x]:
                new = (cost + p.cost + (TRUNCATED if c in "SUA+" and p.letter != "D" else 0), audit + p.letter)
                if p.head not in scanned or new < scanned[p.head]:
                    scanned[p.head] = new
        column = _complete(scanned)
    return column


def extend(column: Chart, tables: dict[str, Chart]) -> Chart:
    """The last column after a further piece, whose charts from each symbol are given."""
    out: Chart = {}
    for x, (cost, audit) in column.items():
        for y, (more, letters) in tables[x].items():
            new = (cost + more, audit + letters)
            if y not in out or new < out[y]:
                out[y] = new
    return out


def parse_long(rows: str, start: str = "N") -> Chart:
    """As `parse`, for any length: pieces are parsed from every symbol and joined, so that no audit is copied for each row."""
    column = parse(rows[:PIECE], start)
    for i in range(PIECE, len(rows), PIECE):
        piece = rows[i : i + PIECE]
        column = extend(column, {x: parse(piece, x) for x in column})
    return column


def best(column: Chart) -> tuple[int, str]:
    return min(column[x] for x in GOALS if x in column)


def pieces_of(audit: str, sizes: list[int]) -> list[str]:
    """An audit cut behind the letters of as many rows each as given; inserts before a cut's next row go with that row, the last piece has the rest."""
    out, at = [], 0
    for n in sizes[:-1]:
        begin = at
        while n:
            n -= audit[at] != "I"
            at += 1
        out.append(audit[begin:at])
    return [*out, audit[at:]]


def turns_left(audit: str) -> int:
    return len(audit) - audit.count("D")


def apply(audit: str, rows: list[tuple[str, str]], emitted: int, system: bool) -> list[tuple[str, str]]:
    """Repaired turns of rows under their piece of the audit; `emitted` turns stand before them. A repaired conversation begins with a
    system turn just if its number of turns is odd."""
    out, row = [], iter(rows)
    for letter in audit:
        role, text = next(row) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if (emitted + len(out) - system) % 2 else "user"
        out.append((role, text))
    return out

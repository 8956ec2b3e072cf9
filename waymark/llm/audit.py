"""Repair of conversations' structure by the cheapest edits, found with a persistent audit.

A dynamic program runs over a conversation's rows with four states (nothing yet, a system row, a user row, an assistant row).
The best edits that lead to a state are a node of a tree of shared prefixes: it knows its parent, a rolling hash of the
prefix and its ancestors at powers of two, so that two prefixes of equal cost are ordered by a search for their longest common
prefix; what equal hashes say is verified along the differing nodes.  Prefixes that all states share are settled, and their rows leave.

Rows of a conversation are in one task, in order, as the repaired text is a sequence; a task streams, so it holds the
undecided rows of one conversation only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, where a user's or an assistant's row leads.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows after which shared prefixes are settled, and conversations of up to so many rows that are remembered.
SETTLE, SHORT, MEMORY = 1024, 32, 50_000
MODULUS, BASE = (1 << 61) - 1, 1_000_003
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


class Prefixes:
    """A tree of strings: a node is a string, its parent all but the last character."""

    def __init__(self) -> None:
        self.parent, self.char, self.depth, self.hash, self.ups = [-1], [""], [0], [0], [()]

    def add(self, node: int, char: str) -> int:
        ups, at = [node], node
        while len(self.ups[at]) >= len(ups):
            at = self.ups[at][len(ups) - 1]
            ups.append(at)
        self.parent.append(node)
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(char)) % MODULUS)
        self.ups.append(tuple(ups))
        return len(self.parent) - 1

    def lift(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.ups[node][k]
            steps, k = steps >> 1, k + 1
        return node

    def before(self, a: int, b: int) -> bool:
        """Whether a's string stands before b's."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, self.depth[a] - least), self.lift(b, self.depth[b] - least)
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.ups[x]))):
                if k < len(self.ups[x]) and self.hash[self.ups[x][k]] != self.hash[self.ups[y][k]]:
                    x, y = self.ups[x][k], self.ups[y][k]
        # equal hashes are verified: the first difference on the way up to a shared node counts
        first, p, q = None, x, y
        while p != q:
            if self.char[p] != self.char[q]:
                first = p, q
            p, q = self.parent[p], self.parent[q]
        return self.depth[a] < self.depth[b] if first is None else self.char[first[0]] < self.char[first[1]]

    def shared(self, nodes: list[int]) -> int:
        """The deepest node above all of nodes (or one of them)."""
        a = nodes[0]
        for b in nodes[1:]:
            least = min(self.depth[a], self.depth[b])
            a, b = self.lift(a, self.depth[a] - least), self.lift(b, self.depth[b] - least)
            for k in reversed(range(len(self.ups[a]))):
                if k < len(self.ups[a]) and self.ups[a][k] != self.ups[b][k]:
                    a, b = self.ups[a][k], self.ups[b][k]
            a = a if a == b else self.parent[a]
        return a

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Audit:
    """The cheapest edits of the rows so far, for each state; ties go to the least string of edits.

    Two strings of equal cost for the same rows and state are never one the other's beginning, so the lesser stays so."""

    def __init__(self) -> None:
        self.tree = Prefixes()
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}
        self._insert()

    def _offer(self, best: dict[int, tuple[int, int]], state: int, cost: int, node: int, edit: str) -> None:
        was = best.get(state)
        if was is None or cost <= was[0]:
            new = self.tree.add(node, edit)
            if was is None or cost < was[0] or self.tree.before(new, was[1]):
                best[state] = cost, new

    def _insert(self) -> None:
        for state in (START, SYSTEM, ASSISTANT, USER):
            if state in self.best:
                cost, node = self.best[state]
                self._offer(self.best, NEXT[state], cost + COST[INSERT], node, INSERT)
        # what insertion gave an assistant's row can't better a user's: it came from one

    def row(self, code: str) -> None:
        """A row: the initial of its role (upper case: truncated), or D, which must be deleted."""
        best: dict[int, tuple[int, int]] = {}
        extra, initial = TRUNCATED * code.isupper(), code.lower()
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + COST[DELETE], node, DELETE)
            if code == "D":
                continue
            to = NEXT[state]
            self._offer(best, to, cost + COST[REROLE] + extra, node, REROLE)
            if initial == ("u" if to == USER else "a"):
                self._offer(best, to, cost + extra, node, KEEP)
            elif initial == "s" and state == START:
                self._offer(best, SYSTEM, cost + extra, node, KEEP)
        self.best = best
        self._insert()
        # what follows a system row may follow an assistant's, and what follows nothing, but for a system row (3 to delete)
        done = self.best[ASSISTANT][0]
        self.best = {s: x for s, x in self.best.items() if not (s == SYSTEM and x[0] > done or s == START and x[0] > done + COST[DELETE])}

    def settled(self) -> str:
        """The edits that all states share and that were not given yet; the tree keeps what is open only."""
        old, tree = self.tree, Prefixes()
        top = old.shared([n for _, n in self.best.values()])
        made = {top: 0}
        for state, (cost, node) in self.best.items():
            path = []
            while node not in made:
                path.append(node)
                node = old.parent[node]
            for x in reversed(path):
                made[x] = tree.add(made[old.parent[x]], old.char[x])
            self.best[state] = cost, made[path[0] if path else node]
        self.tree = tree
        return old.text(top)

    def end(self) -> tuple[str, int]:
        """The edits not given yet, and what all cost."""
        found = None
        for state in (START, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                if found is None or cost < found[0] or cost == found[0] and self.tree.before(node, found[1]):
                    found = cost, node
        return self.tree.text(found[1]), found[0]


_known: dict[str, str] = {}


def edits(codes: str) -> str:
    """The edits of a whole conversation of few rows; the same rows are asked for again and again."""
    if codes not in _known:
        if len(_known) >= MEMORY:
            _known.clear()
        audit = Audit()
        for c in codes:
            audit.row(c)
        _known[codes] = audit.end()[0]
    return _known[codes]


def checked(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, fault, code) of all rows, a conversation's in one partition and in order: by turn (nulls first), role and text.
    Nulls of role and text are one space.  The exchange by conversation serves the search for duplicates, too."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text")).repartition("conv")
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault: Column = F.when(last == "", "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    code = F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    out = rows.withColumn("fault", fault).withColumn("code", code)
    return out.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")


class _Writer:
    """Gathers rows into batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, *row) -> None:
        self.rows.append(row)
        self.size += 64 + len(row[5])

    def full(self) -> bool:
        return self.size >= 1 << 22

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _repairer(schema: pa.Schema):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, none = _Writer(schema), object()
        now, waiting, audit, taken, place, state = none, [], None, 0, 0, START

        def apply(found: str) -> None:
            nonlocal taken, place, state
            for edit in found:
                if edit == INSERT:
                    state = NEXT[state]
                    out.put(now, place, None, ROLE[state], None, "", "", edit, COST[edit])
                else:
                    turn, role, text, fault, code = waiting[taken]
                    taken += 1
                    if edit == KEEP:
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[code.lower()]
                    elif edit == REROLE:
                        state = NEXT[state]
                    extra = TRUNCATED * (fault == "truncated" and edit != DELETE)
                    out.put(now, place, turn, ROLE[state] if edit == REROLE else role, role, text, fault, edit, COST[edit] + extra)
                place += 1

        def finish() -> None:
            if now is not none:
                apply(audit.end()[0] if audit else edits("".join(r[4] for r in waiting)))

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is none or conv != now:
                    finish()
                    now, waiting, audit, taken, place, state = conv, [], None, 0, 0, START
                waiting.append(row)
                if audit is None and len(waiting) > SHORT:
                    audit = Audit()
                    for r in waiting:
                        audit.row(r[4])
                elif audit is not None:
                    audit.row(row[4])
                    if len(waiting) - taken >= SETTLE and len(waiting) % SETTLE == 0:
                        apply(audit.settled())
                        waiting, taken = waiting[taken:], 0
                if out.full():
                    yield out.take()
        finish()
        if out.rows:
            yield out.take()

    return repair


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every row with its cheapest edit, and the inserted ones: (conv, place, turn, role, was, text, fault, edit, cost).

    Kept (K), re-roled (R) and inserted (I) rows, in the order of place, make conversations whose roles begin with
    ``(s?(ua)+)?``; deleted rows (D) stand among them.  Keeping costs nothing, re-roling to user or assistant 2, deleting 3
    (blank rows and duplicates must go), inserting an empty user's or assistant's row 2, and a truncated row that stays 1.  Of
    equally cheap repairs the one whose edits make the least string is taken.

    Rows are in order of turn (nulls first), role and text; nulls of role and text are one space.  A null
    conversation is one of its own.  A row is blank, else a duplicate of an earlier one by role and text, else truncated if its
    last character isn't one of ``.!?``; repeated rows are duplicates.  Roles count by their initial; one without is never kept.
    An empty table gives an empty one; other columns of df are not looked at.  Rows of a conversation stay in one
    partition and in order, so a step over partitions can go on from here."""
    rows = checked(df, conv_col, turn_col, role_col, text_col)
    schema = T.StructType().add("conv", df.schema[conv_col].dataType).add("place", T.LongType()).add("turn", df.schema[turn_col].dataType)
    for name in ("role", "was", "text", "fault", "edit"):
        schema = schema.add(name, T.StringType())
    schema = schema.add("cost", T.IntegerType())
    return rows.select("conv", "turn", "role", "text", "fault", "code").mapInArrow(_repairer(to_arrow_schema(schema)), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal, none = {"su", "ua", "au"}, object()
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    now, rows = none, []

    def close() -> None:
        turns = high - low + 1 - distinct if distinct else 0
        rows.append((now, turns, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()))

    for batch in batches:
        kinds = [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        for conv, _, turn, role, was, text, fault, edit, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is none or conv != now:
                if now is not none:
                    close()
                now, digest, audit, first, last = conv, sha256(), [], True, None
                low = high = None
                distinct = illegal = cost = 0
                faults = dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
            cost += price
            audit.append(edit)
            if edit != INSERT:
                faults[fault] += 1
                initial = was[:1]
                illegal += last is not None and last + initial not in legal
                last = initial
                if turn is not None:
                    low = turn if low is None else low
                    distinct += turn != high
                    high = turn
            if edit != DELETE:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if now is not none:
        close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digests(fixed: DataFrame) -> DataFrame:
    """One row for each conversation of repaired(), with no further exchange: faults, gaps of turns, illegal neighbours, cost, audit and
    the SHA-256 of the repaired rows (``role:text`` joined by newlines)."""
    kind = fixed.schema["conv"].dataType.simpleString()
    return fixed.mapInArrow(_digests, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.  Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def audit_report(df: DataFrame) -> DataFrame:
    """The digests of conversations after damage and repair; a conversation that lost all its rows has zeros."""
    found = digests(repaired(damaged(df)))
    ids = df.select("conv_id").distinct()
    out = ids.join(found, ids.conv_id.eqNullSafe(found.conv), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))

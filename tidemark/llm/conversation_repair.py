"""Cheapest repair of conversation structure through a suffix-shared automaton of role/fault signatures.

A row's signature is one letter: what its role and its first fault allow. A conversation's signature is the string of its rows'
letters, a byte a row, and the cheapest edits depend on nothing else. So the different signatures of all conversations are put in
order of their reversed strings and dealt to tasks by ranges of it: strings that end alike lie side by side and share the nodes of
their common suffix, which are built once, from the end. Each node holds, for each state of the grammar, the cost to go and the
first letter of the best audit of its suffix. Costs to go of different suffixes differ by few patterns once their least is taken
off (two inserts lead from any state to any other), so nodes are minimised to a small register of such patterns; an arc from one to
the next is computed once. An audit is read off by walking the nodes forward.

Two passes over the rows, each with one shuffle by conversation, sorted and streamed: the first makes signatures, the second reads
the rows again behind their audit and hashes the repaired text as it goes by. Of a conversation a task holds a few bytes a row and
never its texts, so one very long conversation (or one id with a large part of all rows) needs time, not memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: States of the grammar (s?(ua)+)?: at the start, after s, after u, after a. Moves by role initial; the states at which it may end.
STATES = 4
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and of an undeleted truncated row.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
#: Signature letters: a row that must go; otherwise its role initial (o: another one), in capitals if truncated.
MUST_GO = "d"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost) after the damage by crc32 of conv_id:turn modulo 20; nulls are one space there, and null
    roles and texts become one: 0 loses a row (kept with lost = true, so its conversation is known), 1 empties its text, 2 removes
    its full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, lost) with fault: blank, duplicate, truncated or null, dealt by conversation.

    The window over equal rows needs no shuffle of its own, since rows already lie together by conversation."""
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "lost", "role", "text").orderBy("turn")
    full = F.rtrim("text", F.lit(BLANKS))
    open_end = ~F.right(full, F.lit(1)).isin(".", "!", "?")
    fault: Column = F.when(full == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(open_end, "truncated")
    return dealt.withColumn("fault", fault)


def _letter(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return MUST_GO
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


_ORDER = ("turn", "role", "text")  # ascending puts nulls first


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, reversed, gaps, blank, duplicate, truncated, illegal) of each conversation of rows with faults; reversed is its
    signature from the end. Counts go by as rows do; a row is one letter of what is held."""
    line = rows.sortWithinPartitions("conv_id", "lost", *_ORDER).select("conv_id", "lost", "turn", "role", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def finish():
            turns, least, most, distinct = now["turns"]
            gaps = most - least + 1 - distinct if turns else 0
            done.append((now["conv"], now["letters"][::-1].decode(), gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"]))

        for batch in batches:
            for conv, lost, turn, role, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        finish()
                    now = {"conv": conv, "letters": bytearray(), "turns": (0, 0, 0, 0), "before": None} | dict.fromkeys(COUNTS, 0)
                if lost:
                    continue
                now["letters"] += _letter(role, fault).encode()
                if fault:
                    now[fault] += 1
                if now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = role[:1]
                if turn is not None:  # turns rise
                    seen, least, most, distinct = now["turns"]
                    now["turns"] = (1, least if seen else turn, turn, distinct + (not seen or turn != most))
            if done:
                yield _batch(done, kinds, names)
                done = []
        if now is not None:
            finish()
            yield _batch(done, kinds, names)

    id_type = rows.schema["conv_id"].dataType
    names = ["conv_id", "reversed", *COUNTS]
    kinds = [_arrow(id_type), pa.string(), *[pa.int64()] * len(COUNTS)]
    schema = f"conv_id {id_type.simpleString()}, reversed string, " + ", ".join(f"{c} long" for c in COUNTS)
    return line.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Automaton:
    """The register of minimised nodes. Node 0 is the empty suffix.

    costs[node][state] is the cost to go, less the least of the node; arcs[letter, node] = (node before, what its least adds,
    best first edits): for each state the edit letters up to and with the one that takes the row, and the state then."""

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, ...], int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.arcs: dict[tuple[str, int], tuple[int, int, tuple[tuple[str, int], ...]]] = {}
        plain = [(0, "") if g in ENDS else None for g in range(STATES)]
        best = _with_inserts([None if p is None else (*p, g) for g, p in enumerate(plain)])
        self.at_end = tuple(edits for _, edits, _ in best)
        self._node([cost for cost, _, _ in best])  # the least is 0

    def _node(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.nodes:
            self.nodes[key] = len(self.costs)
            self.costs.append(key)
        return self.nodes[key], least

    def before(self, letter: str, node: int) -> tuple[int, int, tuple[tuple[str, int], ...]]:
        """The node of a suffix with one more row in front."""
        if (letter, node) not in self.arcs:
            to_go, row = self.costs[node], []
            for g in range(STATES):
                ways = [(DELETE + to_go[g], "D", g)]
                if letter != MUST_GO:
                    extra = TRUNCATED if letter.isupper() else 0
                    if letter.lower() in MOVES[g]:
                        to = MOVES[g][letter.lower()]
                        ways.append((KEEP + extra + to_go[to], "K", to))
                    ways += [(REROLE + extra + to_go[MOVES[g][r]], "R", MOVES[g][r]) for r in ROLES if r in MOVES[g]]
                row.append(min(ways))
            best = _with_inserts(row)
            self.arcs[letter, node] = (*self._node([b[0] for b in best]), tuple(b[1:] for b in best))
        return self.arcs[letter, node]


def _with_inserts(ways: list[tuple[int, str, int] | None]) -> list[tuple[int, str, int]]:
    """The best (cost, edits, state then) of each state if rows may be inserted first. Edits with equal costs differ in a letter
    before the shorter one ends, so the order of strings decides as that of whole audits does."""
    best = list(ways)
    for _ in range(STATES):  # no state is entered twice
        for g in range(STATES):
            for r in ROLES:
                then = best[MOVES[g][r]] if r in MOVES[g] else None
                if then is not None:
                    way = (INSERT + then[0], "I" + then[1], then[2])
                    best[g] = way if best[g] is None else min(best[g], way)
    return best


def best_audits(strings: DataFrame, partitions: int) -> DataFrame:
    """(reversed, cost, audit) of each different signature of strings (reversed)."""
    dealt = strings.select("reversed").distinct().repartitionByRange(partitions, "reversed").sortWithinPartitions("reversed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        path, nodes, costs = "", [0], [0]  # nodes and their least costs along the suffix of the last signature
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                shared = _common(path, text)
                del nodes[shared + 1 :], costs[shared + 1 :]
                for letter in text[shared:]:
                    node, least, _ = automaton.before(letter, nodes[-1])
                    nodes.append(node)
                    costs.append(costs[-1] + least)
                path, state, audit = text, 0, []
                for k in range(len(text), 0, -1):
                    edits, state = automaton.arcs[text[k - 1], nodes[k - 1]][2][state]
                    audit.append(edits)
                cost = costs[-1] + automaton.costs[nodes[-1]][0]
                out.append((text, cost, "".join(audit) + automaton.at_end[state]))
            if out:
                yield _batch(out, [pa.string(), pa.int64(), pa.string()], ["reversed", "cost", "audit"])

    return dealt.mapInArrow(run, "reversed string, cost long, audit string")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def repair_conversations(conversations: DataFrame, damage: bool = True, n_partitions: int | None = None) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    conversations needs conv_id, turn, role and text; other columns are ignored. Rows are damaged first, see damaged(), unless
    damage is False; nulls in role and text are one space, a null conv_id is a conversation of its own. A conversation's rows are
    taken by turn, nulls first; rows of the same turn by role, then by text. Rows that repeat are duplicates. A role that is empty
    or has another initial than s, u or a cannot be kept. The audit is the cheapest edits' initials (Keep, Rerole, Delete, Insert),
    the ASCII-least of those that cost the same. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    if damage:
        rows = damaged(conversations).drop("copy")
    else:
        role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
        rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.lit(False).alias("lost"))
    found = stored(signatures(with_faults(rows)))
    partitions = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = found.join(best_audits(found, partitions), "reversed").drop("reversed")
    return _hashed(rows.filter(~F.col("lost")), heads)


def _hashed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads (conv_id, counts, cost, audit) with repaired_sha256, from one pass over each conversation's rows behind its head."""
    id_type = rows.schema["conv_id"].dataType
    numbers = [*COUNTS, "cost"]
    line = heads.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        "audit", F.array(*numbers).alias("numbers"),
    ).unionByName(rows.select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", "text",
        F.lit(None).cast("string").alias("audit"), F.lit(None).cast("array<long>").alias("numbers"),
    ))
    line = line.repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for conv, part, _, role, text, audit, numbers_ in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if now is not None:
                        done.append(now.finished())
                    now = _Repaired(conv, audit, numbers_)
                else:
                    now.take(role, text)
            if done:
                yield _batch(done, kinds, names)
                done = []
        if now is not None:
            yield _batch([now.finished()], kinds, names)

    names = ["conv_id", *numbers, "audit", "repaired_sha256"]
    kinds = [_arrow(id_type), *[pa.int64()] * len(numbers), pa.string(), pa.string()]
    schema = f"conv_id {id_type.simpleString()}, " + ", ".join(f"{c} long" for c in numbers) + ", audit string, repaired_sha256 string"
    return line.mapInArrow(run, schema)


class _Repaired:
    """The hash of a conversation's repaired rows, row by row. What the audit leaves open follows from the grammar: the number of
    rows that stay says whether the first one is s, and after that u and a take turns."""

    def __init__(self, conv, audit: str, numbers: list[int]) -> None:
        self.conv, self.audit, self.numbers, self.at = conv, audit, numbers, 0
        self.written, self.hash = 0, hashlib.sha256()
        self.odd = (len(audit) - audit.count("D")) % 2

    def _write(self, role: str | None, text: str) -> None:
        if role is None:
            role = ROLES["a" if (self.written - self.odd) % 2 else "u"]
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write(None, "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else None, text)

    def finished(self) -> tuple:
        self._inserts()
        return self.conv, *self.numbers, self.audit, self.hash.hexdigest()

"""Conversation structure repair: least-cost edits by a Viterbi search that emits what its survivors agree on.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. The search
runs over the rows in order with four states (nothing yet, after system, after
user, after assistant). Each state keeps one survivor: the cheapest edits that lead
there, ties to the ASCII-least string of edit initials. Survivors share a tree of
back pointers whose nodes count their references; a node no survivor needs any more
goes at once, and as soon as all survivors have one ancestor, the edits up to it are
final and are emitted. What stays in memory is the unresolved part only. Tied
survivors are compared on their complete unresolved parts: their order is kept up to
date row by row, so a comparison takes no longer for a long part.

An insertion is made directly before the kept or reroled row that needs it, or at
the end: put before a deletion, it would give the greater string at the same cost.
So survivors always end with the letter of a row, none is a prefix of another, and
comparing two of them decides for all that may follow. A survivor goes when another
one, by inserting or deleting at most as much as it is dearer, can do whatever it may
still do (``_CATCH_UP``); a tie is never cut that way.

Spark deals the conversations out, marks blank, repeated and truncated rows and sorts
them by turn; a task reads the sorted rows as a stream, so a conversation of any
length passes without being collected. One very long conversation is still one
stream, as its hash is a chain over all its rows. Some conversations stay unresolved
to their end (if every row has the role user, the last one tells whether the first
two are user and assistant); then their repaired rows are held until it is reached.

Defined results
* a null role or text is one blank; a null conversation id is a conversation of its own.
* rows of one turn follow in order of role, then text; a repeated row is a duplicate of the first.
* roles are told apart by their first character (case-sensitive); other than s, u and a can't be kept, nor can an empty role.
* a conversation without rows: zeros, empty audit, hash of the empty string. An empty table gives an empty result.
* extra columns aren't read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What the state of the row at most pays to follow any course that the state of the column has left (see the module docstring).
_CATCH_UP = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
_ROLE = {"u": "user", "a": "assistant"}


class Edit:
    """A node of the back-pointer tree: an edit and the edits that follow it in some survivor."""

    __slots__ = ("heads", "letter", "next", "parent", "role", "text")

    def __init__(self, letter: str, role: str, text: str, parent: Edit | None):
        self.letter, self.role, self.text, self.parent = letter, role, text, parent
        self.heads, self.next = 0, set()
        if parent is not None:
            parent.next.add(self)


class Repair:
    """The search over one conversation; ``emit(edit)`` gets each edit once it is final, in order."""

    def __init__(self, emit):
        self.emit = emit
        self.root = Edit("", "", "", None)
        self.root.heads = 1
        # state -> (cost, last edit, place among the survivors' strings)
        self.live: dict[int, tuple[int, Edit, int]] = {NOTHING: (0, self.root, 0)}

    def _ways(self, state: int, role: str, fixed: bool, late: int):
        """Ways on from ``state`` over a row: (cost, initials, next state, its role)."""
        yield DELETE, "D", state, ""
        if fixed:
            return
        first = role[:1]
        if first == "s" and state == NOTHING:
            yield KEEP + late, "K", SYSTEM, role
        for to, need, end in (("u", state != USER, USER), ("a", state == USER, ASSISTANT)):
            cost, letter, name = (KEEP, "K", role) if first == to else (REROLE, "R", _ROLE[to])
            yield (cost + late, letter, end, name) if need else (cost + INSERT + late, "I" + letter, end, name)

    def row(self, role: str, text: str, must_delete: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        for state, (paid, head, place) in self.live.items():
            for cost, letters, to, name in self._ways(state, role, must_delete, TRUNCATED * truncated):
                # the order of two survivors is the order of all they have not emitted yet
                way = (paid + cost, place, letters, head, name)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        kept = [(to, w) for to, w in best.items() if all(w[0] <= v[0] + _CATCH_UP[x][to] for x, v in best.items())]
        kept.sort(key=lambda x: x[1][1:3])
        self._move({to: (w[0], self._add(w[3], w[2], w[4], text), i) for i, (to, w) in enumerate(kept)})

    def _add(self, head: Edit, letters: str, role: str, text: str) -> Edit:
        for letter in letters:
            if letter == "I":
                # the kept or reroled row that follows tells which role is missing before it
                head = Edit("I", _ROLE["a" if role[:1] == "u" else "u"], "", head)
            else:
                head = Edit(letter, role, text if letter != "D" else "", head)
        return head

    def _move(self, live: dict[int, tuple[int, Edit, int]]) -> None:
        for _, head, _ in live.values():
            head.heads += 1
        for _, head, _ in self.live.values():
            head.heads -= 1
            while not head.heads and not head.next and head.parent is not None:  # nobody needs it
                head.parent.next.discard(head)
                head = head.parent
        self.live = live
        while not self.root.heads and len(self.root.next) == 1:  # all survivors come from one edit: it is final
            self.root = self.root.next.pop()
            self.root.parent = None
            self.emit(self.root)

    def finish(self) -> int:
        """Emit what is left and return the cost."""
        ways = []
        for state, (paid, head, place) in self.live.items():
            missing = {USER: ["a"], SYSTEM: ["u", "a"]}.get(state, [])
            ways.append((paid + INSERT * len(missing), place, head, missing))
        cost, _, head, missing = min(ways, key=lambda w: w[:2])
        for role in missing:
            head = Edit("I", _ROLE[role], "", head)
        self._move({NOTHING: (cost, head, 0)})
        while self.root.next:  # a single chain is left
            self.root.heads = 0
            self.root = self.root.next.pop()
            self.root.parent = None
            self.emit(self.root)
        return cost


class _Report:
    """What a conversation's rows and edits add up to."""

    def __init__(self):
        self.search = Repair(self._emit)
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.before = None
        self.turns = 0

    def _emit(self, edit: Edit) -> None:
        self.audit.append(edit.letter)
        if edit.letter != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{edit.role}:{edit.text}".encode())
            self.lines += 1

    def row(self, turn, role: str, text: str, blank: bool, copy: bool, late: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        copy, late = copy and not blank, late and not (blank or copy)
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + copy, self.truncated + late
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.search.row(role, text, blank or copy, late)

    def result(self) -> tuple:
        cost = self.search.finish()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


class _Rows:
    """The repaired conversation itself: (place, edit, role, text) of every row that stays."""

    def __init__(self):
        self.search, self.done, self.place = Repair(self._emit), [], 0

    def _emit(self, edit: Edit) -> None:
        if edit.letter != "D":
            self.done.append((self.place, edit.letter, edit.role, edit.text))
            self.place += 1

    def row(self, turn, role: str, text: str, blank: bool, copy: bool, late: bool) -> None:
        self.search.row(role, text, blank or copy, late and not (blank or copy))


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_STRINGS = {"audit", "repaired_sha256", "edit", "role", "text"}


def _streams(kind: str, id_type):
    """Sorted rows -> a report per conversation, or its repaired rows."""
    import pyarrow as pa

    names = _REPORT if kind == "report" else ("place", "edit", "role", "text")
    schema = [pa.string() if c in _STRINGS else pa.int64() for c in names]

    def batch(out: list[tuple]):
        cols = [list(c) for c in zip(*out)] if out else [[] for _ in range(len(names) + 1)]
        arrays = [pa.array(c, t) for c, t in zip(cols, [id_type, *schema])]
        return pa.RecordBatch.from_arrays(arrays, names=["conv", *names])

    def fn(batches):
        at, work, out = None, None, []

        def close():
            if kind == "report":
                out.append((at, *work.result()))
            else:
                work.search.finish()
                out.extend((at, *x) for x in work.done)

        for b in batches:
            for conv, turn, role, text, lost, blank, late, nth in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "lost", "blank", "late", "nth"))):
                if work is None or conv != at:
                    if work is not None:
                        close()
                    at, work = conv, _Report() if kind == "report" else _Rows()
                if not lost:
                    work.row(turn, role, text, blank, nth > 1, late)
                    if kind == "rows" and work.done:
                        out.extend((at, *x) for x in work.done)
                        work.done = []
            if out:
                yield batch(out)
                out = []
        if work is not None:
            close()
            yield batch(out)

    return fn


def damage(conv: DataFrame) -> DataFrame:
    """The damage of the contract, on (conv, turn, role, text); dropped rows stay as ``lost`` markers of their conversation."""
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = conv.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), (kind == 3).alias("twice"))
    return hit.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("twice").cast("int")))).drop("twice", "_copy")


def repair_conversations(conv: DataFrame, output: str = "report", damaged: bool = False, id_col: str = "conv_id") -> DataFrame:
    """A report per conversation of ``conv`` (id, turn, role, text), or with ``output="rows"`` the repaired rows.

    ``damaged`` applies the contract's damage first.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    blank = F.lit(" ")
    rows = conv.select(F.col(f"`{id_col}`").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = damage(rows) if damaged else rows.withColumn("lost", F.lit(False))
    rows = rows.withColumns({"blank": ~F.col("text").rlike(WORD), "late": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    # one exchange serves both: the repeats of a row inside a conversation, and its order by turn
    same = Window.partitionBy("conv", "lost", "role", "text").orderBy("turn")
    marked = rows.repartition("conv").withColumn("nth", F.row_number().over(same)).sortWithinPartitions("conv", "turn", "role", "text", "nth")
    kind = rows.schema["conv"].dataType
    names = _REPORT if output == "report" else ("place", "edit", "role", "text")
    schema = f"conv {kind.simpleString()}, " + ", ".join(f"{c} {'string' if c in _STRINGS else 'long'}" for c in names)
    out = marked.mapInArrow(_streams(output, to_arrow_type(kind)), schema)
    return out.withColumnRenamed("conv", id_col)


def op13_conversations(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"), damaged=True)


# the search as a recursive query over row numbers: per state a struct (cost, audit, repaired text), the least one stays
_WAYS = {
    "s0": ["way(w.s0, 3, 'D', '', '')"],
    "s1": ["way(w.s1, 3, 'D', '', '')", "way(w.s0, r.keep + CASE WHEN r.first = 's' THEN 0 ELSE 1000000 END, 'K', '', r.line)"],
    "s2": ["way(w.s2, 3, 'D', '', '')"]
    + [f"way(w.{s}, r.keep + CASE WHEN r.first = 'u' THEN 0 ELSE 1000000 END, 'K', '', r.line)" for s in ("s0", "s1", "s3")]
    + [f"way(w.{s}, r.keep + 2, 'R', '', 'user:' || r.text)" for s in ("s0", "s1", "s3")]
    + ["way(w.s2, r.keep + 2 + CASE WHEN r.first = 'u' THEN 0 ELSE 1000000 END, 'IK', 'assistant:', r.line)", "way(w.s2, r.keep + 4, 'IR', 'assistant:', 'user:' || r.text)"],
    "s3": ["way(w.s3, 3, 'D', '', '')", "way(w.s2, r.keep + CASE WHEN r.first = 'a' THEN 0 ELSE 1000000 END, 'K', '', r.line)", "way(w.s2, r.keep + 2, 'R', '', 'assistant:' || r.text)"]
    + [f"way(w.{s}, r.keep + 2 + CASE WHEN r.first = 'a' THEN 0 ELSE 1000000 END, 'IK', 'user:', r.line)" for s in ("s0", "s1", "s3")]
    + [f"way(w.{s}, r.keep + 4, 'IR', 'user:', 'assistant:' || r.text)" for s in ("s0", "s1", "s3")],
}


def _inline(call: str) -> str:
    """way(survivor, cost, letters, inserted, line) as a struct of DuckDB."""
    state, cost, letters, inserted, line = (x.strip() for x in call.removeprefix("way(").removesuffix(")").split(", ", 4))
    lines = "".join(f" || CASE WHEN {x} = '' THEN '' ELSE chr(10) || {x} END" for x in (inserted, line) if x != "''")
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letters}, 'p': {state}.p{lines}}}"


SQL = rf"""
WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, 3988292384 * (b & 1))))) % 20 AS kind FROM n),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM z, (SELECT unnest([1, 2]) AS nth) WHERE kind <> 0 AND (nth = 1 OR kind = 3)),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS late FROM m),
r AS (SELECT *, role[1] AS first, role || ':' || text AS line,
    CASE WHEN blank OR nth > 1 THEN 1000000 WHEN late THEN 1 ELSE 0 END AS keep,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
w AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'p': ''}} AS s0, {{'c': 1000000::BIGINT, 'a': '', 'p': ''}} AS s1,
    {{'c': 1000000::BIGINT, 'a': '', 'p': ''}} AS s2, {{'c': 1000000::BIGINT, 'a': '', 'p': ''}} AS s3 FROM (SELECT DISTINCT conv_id FROM n)
  UNION ALL
  SELECT w.conv_id, r.i, {", ".join(f"list_min([{', '.join(map(_inline, ways))}])" for ways in _WAYS.values())}
  FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
e AS (SELECT conv_id, list_min([s0, s3, {{'c': s2.c + 2, 'a': s2.a || 'I', 'p': s2.p || chr(10) || 'assistant:'}},
    {{'c': s1.c + 4, 'a': s1.a || 'II', 'p': s1.p || chr(10) || 'user:' || chr(10) || 'assistant:'}}]) AS best
  FROM w QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND nth > 1) AS duplicate, count(*) FILTER (NOT blank AND nth = 1 AND late) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(best.p[2:]) AS repaired_sha256
FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""

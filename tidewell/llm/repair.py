"""Conversation structure repair by dynamic programming over a prefix trie.

A conversation is damaged (for a controlled test of repair), its rows are checked for faults, and the cheapest edits are
found that give the roles a legal order: an optional system turn, then user and assistant in turn. A row's edit depends only
on its role's initial and its fault, so a conversation is a string of such symbols, its signature, and few signatures
stand for many conversations. Distinct signatures are sorted over the tasks. Each task walks its sorted signatures as the
trie that they form: the layers of the dynamic program on the way from the root to the present node are on a stack, a
signature pops it to the prefix that it shares with the one before, and only layers behind that are computed; a node that
ends a signature emits the answer. So each prefix is computed once in a task, and a task holds one path of the trie, four
numbers a layer, however many signatures it has.

Of edits with equal cost those whose initials come first in ASCII are taken: nodes of the program that lie on a cheapest
path are marked backwards, and the least letter is followed forwards through them. A string of edits leads through one path
of states, so the order is decided exactly.

Answers go back to conversations by signature, and the repaired text is hashed in a stream over sorted rows. So of a
conversation only its signature and edits, a character a row, are held whole; its texts never are.

Defined cases: nulls of any column count as one space, also in the key of the damage; rows with a null conv_id are one
conversation with a null id; rows of one turn stand by role, then text; an empty role, or one with another initial than s,
u and a, is never legal, so its row is retyped or deleted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, ready, tidy

SPACES = " \t\n\x0b\f\r"
NEVER = 1 << 60
#: Costs of the edits (fixed by the operator's contract).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the legal order: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the state that an inserted or retyped row leads to.
NEXT = (USER, USER, ASSISTANT, USER)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of every row after damage, and ``gone`` rows, which only keep their id."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", (F.col("kind") == 0).alias("gone"), "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))


#: The order of a conversation's rows, a null turn first; those that are gone come last.
ORDER = ["gone", "turn", "role", "text", "copy"]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of a conversation and its signature: a symbol for each row that stands. The symbol is x where the
    row must go, else the role's initial (o for others), as a capital where the text is cut short."""
    place = Window.partitionBy("conv_id").orderBy(*ORDER)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn", "copy")
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    initial = F.left("role", F.lit(1))
    rows = rows.select("conv_id", "gone", "turn", "copy", "role", "text", initial.alias("initial"), end.alias("end"))
    rows = rows.withColumns({"n": F.row_number().over(place), "pair": F.concat(F.lag("initial").over(place), "initial"), "seen": F.row_number().over(same) > 1, "new": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(place))})
    fault = F.when(F.col("end") == "", "blank").when(F.col("seen"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    there = ~F.col("gone")
    rows = rows.withColumn("fault", F.when(there, fault))
    turn = F.when(there, F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(there & F.col("new")), F.lit(0))
    number = lambda kind: F.count_if(F.coalesce(F.col("fault") == kind, F.lit(False))).alias(kind)
    illegal = F.count_if(there & F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au"))
    signature = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(there, F.struct("n", symbol.alias("s"))))), lambda x: x["s"]), "")
    return rows.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), number("blank"), number("duplicate"), number("truncated"), illegal.alias("illegal"), signature.alias("signature"))


def _inserted(cost: list[int]) -> tuple[int, ...]:
    """A layer with the states that insertions reach; three rounds do, as a fourth would come back to a dearer state."""
    for state in (START, SYSTEM, ASSISTANT, USER, ASSISTANT):
        cost[NEXT[state]] = min(cost[NEXT[state]], cost[state] + INSERT)
    return tuple(cost)


def edits(symbol: str) -> list[tuple[str, int, int, int]]:
    """(initial, state before, state after, cost) of what can be done to a row, by initial."""
    found = [("D", s, s, DELETE) for s in range(4)]
    if symbol == "x":
        return found
    more, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
    keeps = {"s": [(START, SYSTEM)], "u": [(s, USER) for s in (START, SYSTEM, ASSISTANT)], "a": [(USER, ASSISTANT)]}.get(role, [])
    return found + [("K", a, b, more) for a, b in keeps] + [("R", s, NEXT[s], REROLE + more) for s in range(4)]


EDITS = {x: edits(x) for x in "suaoSUAOx"}


def layer(before: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    """The least cost of each state after one more row."""
    cost = [NEVER] * 4
    for _, a, b, price in EDITS[symbol]:
        cost[b] = min(cost[b], before[a] + price)
    return _inserted(cost)


def answer(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """The least cost and the least of the strings of edits that have it. ``layers``: before the first row and after each."""
    n, end = len(signature), layers[-1]
    cost = min(end[START], end[ASSISTANT])
    marked = [0] * (n + 1)  # a bit for each state on a cheapest path
    for state in (START, ASSISTANT):
        marked[n] |= (end[state] == cost) << state
    for i in range(n, -1, -1):
        here = layers[i]
        for state in (ASSISTANT, USER, ASSISTANT, SYSTEM, START):
            if marked[i] >> NEXT[state] & 1 and here[state] + INSERT == here[NEXT[state]]:
                marked[i] |= 1 << state
        if i:
            for _, a, b, price in EDITS[signature[i - 1]]:
                if marked[i] >> b & 1 and layers[i - 1][a] + price == here[b]:
                    marked[i - 1] |= 1 << a
    i, state, out = 0, START, []
    while i < n or state not in (START, ASSISTANT) or end[state] != cost:
        choices = [("I", i, NEXT[state])] if marked[i] >> NEXT[state] & 1 and layers[i][state] + INSERT == layers[i][NEXT[state]] else []
        if i < n:
            choices += [(x, i + 1, b) for x, a, b, price in EDITS[signature[i]] if a == state and marked[i + 1] >> b & 1 and layers[i][a] + price == layers[i + 1][b]]
        letter, i, state = min(choices)
        out.append(letter)
    return cost, "".join(out)


def solved(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, layers = "", [_inserted([0, NEVER, NEVER, NEVER])]
        for batch in batches:
            column = batch.column(0).to_pylist()
            out = []
            for signature in column:
                shared = 0
                for a, b in zip(path, signature, strict=False):
                    if a != b:
                        break
                    shared += 1
                del layers[shared + 1 :]
                for symbol in signature[shared:]:
                    layers.append(layer(layers[-1], symbol))
                path = signature
                out.append(answer(signature, layers))
            if out:
                cost, audit = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(tidy(run), "signature string, cost long, audit string")


class _Hash:
    """Applies a string of edits to rows as they come and hashes the repaired text."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = SYSTEM if role.startswith("s") else NEXT[self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", text)

    def end(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits, and the hash of the repaired text."""
    ready(turns.sparkSession)
    rows = damaged(turns)
    found = cut(faults(rows), "signatures")
    answers = cut(solved(found), "answers")
    heads = found.join(answers, "signature").drop("signature")
    names = [x for x in heads.columns if x != "conv_id"]
    kinds = {f.name: f.dataType for f in heads.schema}
    # A conversation's head comes before its rows.
    first = heads.select("conv_id", F.lit(0).alias("after"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ORDER if c != "gone"], *names)
    rest = rows.where("not gone").select("conv_id", F.lit(1).alias("after"), *[c for c in ORDER if c != "gone"], *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    sorted_ = first.union(rest).repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "text", "copy").drop("after", "turn", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, schema = None, None, None
        done: list[dict] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(done, schema)
            done.clear()
            return out

        for batch in batches:
            if schema is None:
                schema = pa.schema([f for f in batch.schema if f.name not in ("role", "text")]).append(pa.field("repaired_sha256", pa.string()))
            audits = batch.column("audit").to_pylist()
            for i, (role, text, audit) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), audits, strict=True)):
                if audit is None:
                    now.row(role, text)
                    continue
                if now is not None:
                    done.append(head | {"repaired_sha256": now.end()})
                head, now = {c: batch.column(c)[i].as_py() for c in schema.names[:-1]}, _Hash(audit)
            if done:
                yield flush()
        if now is not None:
            done.append(head | {"repaired_sha256": now.end()})
            yield flush()

    return sorted_.mapInArrow(tidy(run), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} {kinds[c].simpleString()}' for c in names)}, repaired_sha256 string")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return repair(table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """The same by recursion, row by row: each state's value is its cost in nine digits, its edits, a mark, and the repaired
    text, so that the least value is the cheapest one with the least edits."""
    def step(state: str, cost: str, letter: str, line: str = "") -> str:
        edits_, text = f"split_part(substr({state}, 10), chr(1), 1)", f"substr({state}, instr({state}, chr(1)) + 1)"
        added = f"CASE WHEN {text} = '' THEN '' ELSE {text} || chr(10) END || {line}" if line else text
        return f"lpad((substr({state}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || {edits_} || '{letter}' || chr(1) || {added}"

    role = {"u": "user", "a": "assistant"}
    delete = lambda s: step(s, "2", "D")
    keep = lambda s, x: f"CASE WHEN initial = '{x}' AND NOT must THEN {step(s, 'extra', 'K', 'role || chr(58) || text')} END"
    retype = lambda s, x: f"CASE WHEN NOT must THEN {step(s, 'extra + 1', 'R', chr(39) + role[x] + ':' + chr(39) + ' || text')} END"
    insert = lambda s, x: step(s, "5", "I", f"'{role[x]}:'")
    to_user = ", ".join(f"{keep(s, 'u')}, {retype(s, 'u')}" for s in ("z", "s", "a"))
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind FROM k, t),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
 FROM h, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
 left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS bare, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS short FROM d),
f AS (SELECT *, bare OR seen AS must, CASE WHEN bare THEN 'blank' WHEN seen THEN 'duplicate' WHEN short THEN 'truncated' END AS fault, CASE WHEN short THEN 5 ELSE 0 END AS extra,
 lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM n),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
 count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS last FROM f GROUP BY conv_id),
i AS (SELECT conv_id, 0::BIGINT AS n, repeat('0', 9) || chr(1) AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT x.conv_id, x.n, z, s, least(u, {insert('z', 'u')}, {insert('s', 'u')}, {insert('a', 'u')}), least(a, {insert('u', 'a')}) FROM (
 SELECT i.conv_id, f.n, {delete('z')} AS z, least({delete('s')}, {keep('z', 's')}) AS s, least({delete('u')}, {to_user}) AS u, least({delete('a')}, {keep('u', 'a')}, {retype('u', 'a')}) AS a
  FROM (SELECT conv_id, n, z, s, least(u, {insert('z', 'u')}, {insert('s', 'u')}, {insert('a', 'u')}) AS u, least(a, {insert('u', 'a')}) AS a FROM i) AS i
  JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id AND f.n = i.n + 1) AS x),
e AS (SELECT conv_id, least(z, a) AS best, n FROM i QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 substr(best, 1, 9)::BIGINT AS cost, split_part(substr(best, 10), chr(1), 1) AS audit, sha256(substr(best, instr(best, chr(1)) + 1)) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


SQL = _sql()

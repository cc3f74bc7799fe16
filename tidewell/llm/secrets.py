"""Secret scan: pattern spans, and spans found by inferred grammars.

Base spans are the leftmost non-overlapping matches of three patterns. The strings that these matched, labelled by their
kind, teach a probabilistic automaton for each kind. Their prefix tree, over classes of characters (digits, letters by case
and range, each punctuation mark by itself), is merged state by state, the state with most evidence first, into the
likeliest of the states that stand already and with which it is compatible, all states below the two included: a Hoeffding
test of how they go on and end, for states seen often enough, and a test of how many characters are still to come, which
keeps apart the places of a format of fixed length. What is compatible with no state stands by itself. A state spells its
characters by what it has seen, so a fixed beginning is learnt as letters and not as classes alone. A string that ends
where many examples went on, or goes on where all of many ended, is none of the format.

Every maximal run of credential characters outside the base spans is scored (what stands left and right of a base span
are runs too), by its log likelihood under each automaton less that of an ordinary run: under a chain of characters learnt
from ordinary runs or, one run in ``STRAY``, as characters at random; from a mark on it is added as a span of the likeliest kind. Runs too short for any string of their length to reach
the mark are left aside. Base spans are never changed.

Learning takes at most ``EXAMPLES`` distinct strings of each kind and ``ORDINARY`` ordinary runs of ``SHORTEST`` characters
or more, none longer than ``LONGEST``, the first by hash over the whole corpus; scanning and scoring cover every document's
whole text.

Defined cases: a null or empty text has no spans; an empty table gives no rows; with no examples of a kind its grammar adds
nothing; repeated rows are scanned each; a null doc_id is kept; other columns are ignored or, on request, kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ready, tidy

#: Kinds in their order, and their patterns (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = r"[A-Za-z0-9+/_.=-]"

#: Lengths up to which the shortest run that can reach the mark is looked for; longer ones are scored in any case.
LOOKED = 64

#: Examples of each kind, ordinary runs, and the lengths of what is learnt from.
EXAMPLES, ORDINARY, SHORTEST, LONGEST = 400, 4000, 6, 512
#: The test's confidence, the strings from which on a state's continuations are tested, and the log likelihood ratio that
#: adds a span.
ALPHA, OFTEN, MARK = 0.02, 8, 10.0
#: Of so many ordinary runs one is characters at random, of this mean length; the log likelihood of what can't be.
STRAY, MEAN, NEVER = 1000, 16, -1000.0

_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-"]
_CHARS = "".join(_CLASSES)
_CODE = np.full(128, -1, dtype=np.int64)
_CODE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))
_CLASS = np.repeat(np.arange(len(_CLASSES)), [len(c) for c in _CLASSES])
_END = len(_CHARS)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, the credential) by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int, str]], least: int = 1) -> list[tuple[int, int]]:
    """Runs of ``least`` or more credential characters outside the base spans."""
    run, out, at = _run(least), [], 0
    for start, end in [*((s[0], s[2]) for s in spans), (len(text), len(text))]:
        out += [m.span() for m in run.finditer(text, at, max(at, start))]
        at = max(at, end)
    return out


@lru_cache(maxsize=8)
def _run(least: int) -> re.Pattern:
    return re.compile(f"{RUN}{{{least},}}")


@dataclass(frozen=True)
class Automaton:
    """Probabilistic and deterministic; state 0 is the start. ``to``: next state of each state and character; ``cost``: log
    probabilities, the last column of ending."""

    to: np.ndarray
    cost: np.ndarray


class _Tree:
    """The prefix tree of strings over classes. Of each state: children by class, strings by class and (-1) ending, strings
    by character, and strings by the number of characters still to come."""

    def __init__(self, strings: list[str]):
        self.child: list[dict[int, int]] = []
        self.count: list[Counter] = []
        self.chars: list[Counter] = []
        self.rest: list[Counter] = []
        self._add()
        for s in strings:
            at = 0
            codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)].tolist()
            for k, c in enumerate(codes):
                kind = int(_CLASS[c])
                self.rest[at][len(codes) - k] += 1
                self.count[at][kind] += 1
                self.chars[at][c] += 1
                if kind not in self.child[at]:
                    self.child[at][kind] = self._add()
                at = self.child[at][kind]
            self.rest[at][0] += 1
            self.count[at][-1] += 1

    def _add(self) -> int:
        self.child.append({})
        for each in (self.count, self.chars, self.rest):
            each.append(Counter())
        return len(self.child) - 1

    def alike(self, x: int, y: int, bound: float) -> bool:
        """Whether two states, without those below them, may be one."""
        n, m = self.rest[x].total(), self.rest[y].total()
        limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        few, many = (self.rest[x], self.rest[y]) if n <= m else (self.rest[y], self.rest[x])
        if 4 * len(many) <= max(n, m) and 2 * sum(k for r, k in few.items() if r in many) < min(n, m):
            return False  # lengths to come that are often seen in the one are mostly not those of the other
        if min(n, m) < OFTEN:
            return True
        if any(abs(self.count[x][c] / n - self.count[y][c] / m) > limit for c in self.count[x].keys() | self.count[y].keys()):
            return False
        gap = 0.0
        for r in sorted(self.rest[x].keys() | self.rest[y].keys()):
            gap += self.rest[x][r] / n - self.rest[y][r] / m
            if abs(gap) > limit:
                return False
        return True

    def compatible(self, x: int, y: int, bound: float) -> bool:
        todo = [(x, y)]
        while todo:
            a, b = todo.pop()
            if not self.alike(a, b, bound):
                return False
            todo += [(self.child[a][c], self.child[b][c]) for c in self.child[a].keys() & self.child[b].keys() if self.child[a][c] != self.child[b][c]]
        return True

    def evidence(self, x: int, red: int) -> float:
        """How likely the lengths to come of a state's strings are in another state."""
        n = self.rest[red].total() + 0.5 * (len(self.rest[red]) + 1)
        return sum(k * math.log((self.rest[red][r] + 0.5) / n) for r, k in self.rest[x].items())

    def fold(self, x: int, y: int) -> None:
        """Make the second state, and those below it, one with the first."""
        todo = [(x, y)]
        while todo:
            a, b = todo.pop()
            for each in (self.count, self.chars, self.rest):
                each[a].update(each[b])
            for c, z in self.child[b].items():
                if c not in self.child[a]:
                    self.child[a][c] = z
                elif self.child[a][c] != z:
                    todo.append((self.child[a][c], z))


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton | None:
    """Merge compatible states of the prefix tree of the strings."""
    if not strings:
        return None
    tree, bound, red = _Tree(strings), math.sqrt(0.5 * math.log(2 / alpha)), [0]
    known = {0}
    while True:
        blue = [(tree.rest[z].total(), -r, -c) for r in red for c, z in tree.child[r].items() if z not in known]
        if not blue:
            break
        _, r, c = max(blue)
        parent, kind = -r, -c
        state = tree.child[parent][kind]
        for other in sorted(red, key=lambda x: -tree.evidence(state, x)):
            if tree.compatible(other, state, bound):
                tree.child[parent][kind] = other
                tree.fold(other, state)
                break
        else:
            red.append(state)
            known.add(state)
    place = {s: i for i, s in enumerate(red)}
    to = np.zeros((len(red), _END), dtype=np.int64)
    cost = np.empty((len(red), _END + 1))
    for s, i in place.items():
        share = np.array([tree.count[s][c] + 0.02 for c in (*range(len(_CLASSES)), -1)])
        share /= share.sum()
        for c, members in enumerate(_CLASSES):
            at = _CODE[[ord(x) for x in members]]
            spelt = np.array([tree.chars[s][int(x)] for x in at]) + 1
            cost[i, at] = np.log(share[c] * spelt / spelt.sum())
            to[i, at] = place[tree.child[s][c]] if c in tree.child[s] else i
        cost[i, _END] = math.log(share[-1])
        if tree.rest[s].total() >= OFTEN:
            if not tree.count[s][-1]:
                cost[i, _END] = NEVER
            if not tree.child[s]:
                cost[i, :_END] = NEVER
    return Automaton(to, cost)


def chain(strings: list[str]) -> Automaton:
    """Ordinary runs: a chain over the last character, smoothed towards how common characters are."""
    pairs = np.zeros((_END + 1, _END + 1))  # from the start or a character, to a character or the end
    for s in strings:
        codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(pairs, (np.append(0, codes + 1), np.append(codes, _END)), 1)
    single = pairs.sum(axis=0) + 0.5
    single /= single.sum()
    pairs = np.maximum(pairs - 1, 0)  # a pair met once says nothing, so a stray credential is not learnt by heart
    cost = np.log((pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20))
    return Automaton(np.tile(np.arange(1, _END + 1), (_END + 1, 1)), cost)


def likelihood(model: Automaton, strings: list[str]) -> np.ndarray:
    """Log likelihood of each whole string."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = _CODE[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    first = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    state, total = np.zeros(len(strings), dtype=np.int64), np.zeros(len(strings))
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # those longer than k come first
        c = data[first[:n] + k]
        total[:n] += model.cost[state[:n], c]
        state[:n] = model.to[state[:n], c]
    total += model.cost[state, _END]
    out = np.empty(len(strings))
    out[order] = total
    return out


def at_random(sizes: np.ndarray) -> np.ndarray:
    """Log likelihood of ordinary runs of these lengths that are characters at random."""
    return sizes * math.log((1 - 1 / MEAN) / len(_CHARS)) - math.log(MEAN * STRAY)


def _shortest(kind: Automaton, mark: float) -> int:
    """The fewest characters with which the likeliest string reaches the mark, ``LOOKED`` at most."""
    best = np.full(len(kind.to), -np.inf)  # of a state: the likeliest way there
    best[0] = 0
    for n in range(1, LOOKED):
        after = np.full_like(best, -np.inf)
        np.maximum.at(after, kind.to, best[:, None] + kind.cost[:, :_END])
        best = after
        if (best + kind.cost[:, _END]).max() - at_random(np.array([n]))[0] >= mark - 1e-6:
            return n
    return LOOKED


@dataclass(frozen=True)
class Grammars:
    kinds: tuple[Automaton | None, ...]
    ordinary: Automaton
    mark: float

    @cached_property
    def least(self) -> int:
        """The shortest length of which a string can reach the mark."""
        return min((_shortest(k, self.mark) for k in self.kinds if k), default=LOOKED)

    def judge(self, strings: list[str]) -> list[int | None]:
        """The kind of each string, or None."""
        if not strings or not any(self.kinds):
            return [None] * len(strings)
        each, strings = strings, list(dict.fromkeys(strings))
        base = np.maximum(likelihood(self.ordinary, strings), at_random(np.array([len(x) for x in strings])))
        scores = np.stack([np.full(len(strings), -np.inf) if k is None else likelihood(k, strings) - base for k in self.kinds])
        best, most = scores.argmax(axis=0), scores.max(axis=0)
        known = {strings[i]: int(best[i]) for i in np.flatnonzero(most >= self.mark)}
        return [known.get(x) for x in each]


def learn(docs: DataFrame, examples: int = EXAMPLES, ordinary: int = ORDINARY, mark: float = MARK, text_column: str = "text") -> Grammars:
    """Infer the grammars from the corpus's own base spans. The strings, at most ``examples`` of each kind and ``ordinary``
    others, come to the driver."""
    ready(docs.sparkSession)

    most = max(examples, ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's first distinct strings of each kind by hash; those of the whole are among them."""
        held: list[dict[str, int]] = [{} for _ in range(len(KINDS) + 1)]
        marks = [1 << 32] * len(held)  # the hash up to which strings can matter

        def add(kind: int, s: str) -> None:
            h = zlib.crc32(s.encode())
            if h <= marks[kind] and len(s) <= LONGEST:
                held[kind][s] = h
                if len(held[kind]) > 4 * most:
                    marks[kind] = sorted(held[kind].values())[most - 1]
                    held[kind] = {s: h for s, h in held[kind].items() if h <= marks[kind]}

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    spans = base_spans(text)
                    for _, kind, _, s in spans:
                        add(kind, s)
                    for a, b in candidates(text, spans, SHORTEST):
                        add(len(KINDS), text[a:b])
        for kind, strings in enumerate(held):
            if strings:
                s = sorted(strings, key=lambda x: (strings[x], x))[:most]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(s), pa.int32()), pa.array([strings[x] for x in s], pa.int64()), pa.array(s, pa.string())], names=["kind", "h", "s"])

    each = docs.select(F.col(text_column).cast("string")).mapInArrow(tidy(run), "kind int, h long, s string").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "s"))
    few = each.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") <= F.when(F.col("kind") < len(KINDS), examples).otherwise(ordinary))
    rows = sorted((r["kind"], r["s"]) for r in few.select("kind", "s").collect())
    of = lambda k: [s for kind, s in rows if kind == k]
    return Grammars(tuple(infer(of(k)) for k in range(len(KINDS))), chain(of(len(KINDS))), mark)


def scan(docs: DataFrame, grammars: Grammars, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """All spans of each document: doc_id (or, with ``keep``, all columns), n_assign, n_access, n_hex, base, spans; the
    last two are arrays of (start, kind, end, added)."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(grammars)
    fields = docs.schema.fields if keep else [docs.schema[id_column]]
    names = [f.name for f in fields]
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per, runs, owners = [], [], []
            for i, text in enumerate(batch.column("__text").to_pylist()):
                base = base_spans(text) if text else []
                per.append(base)
                if text:
                    for a, b in candidates(text, base, sent.value.least):
                        runs.append(text[a:b])
                        owners.append((i, a, b))
            extra: list[list[tuple[int, int, int]]] = [[] for _ in per]
            for kind, (i, a, b) in zip(sent.value.judge(runs), owners, strict=True):
                if kind is not None:
                    extra[i].append((a, kind, b))
            spans = [[{"start": a, "kind": KINDS[k], "end": b, "added": x} for a, k, b, x in sorted([(*s[:3], False) for s in base] + [(*e, True) for e in more])] for base, more in zip(per, extra, strict=True)]
            counts = [pa.array([sum(s[1] == k for s in base) for base in per], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, pa.array(spans, span)], names=[*names, "n_assign", "n_access", "n_hex", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    source = docs.select(*[F.col(f"`{n}`") for n in names], F.col(text_column).cast("string").alias("__text"))
    return source.mapInArrow(tidy(run), f"{kinds}, n_assign long, n_access long, n_hex long, spans array<struct<start:long,kind:string,end:long,added:boolean>>")


def redact(docs: DataFrame, grammars: Grammars, text_column: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents, all columns kept, with every span of the whole text masked; spans that overlap are masked as one."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(grammars)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            spans = [[s[:3:2] for s in b] for b in base]
            owners = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t, base[i], sent.value.least)]
            for kind, (i, a, b) in zip(sent.value.judge([texts[i][a:b] for i, a, b in owners]), owners, strict=True):
                if kind is not None:
                    spans[i].append((a, b))
            for i, found in enumerate(spans):
                out, at, until = [], 0, -1
                for a, b in sorted(found):
                    if a >= until:
                        out += [texts[i][at:a], mask]
                        at = b
                    until = at = max(at, b)
                if found:
                    texts[i] = "".join([*out, texts[i][at:]])
            columns = [pa.array(texts, c.type) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    base = F.filter("spans", lambda s: ~s["added"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

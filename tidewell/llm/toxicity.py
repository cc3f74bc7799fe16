"""Toxicity by weak supervision.

Voters look at a text and vote for the toxic class or abstain: lexicon voters for single words, pattern voters for
beginnings of words, both induced from the labelled sample, and pattern voters written by hand; one more votes for the
clean class where no induced voter fires. A generative label model has a hidden class behind the votes. Expectation
maximisation over labelled and unlabelled documents estimates how often each voter votes so under either class; what
voters share beyond the class is estimated as pairwise correlations, and a voter's evidence is divided by what it shares
with others. Given labels set where it starts and are one more voter of bounded weight (``TRUST``), so voters that agree
overrule a label. The posterior labels of that model train a linear classifier on the votes, which scores every document.

Labels come from at most ``SAMPLE_ROWS`` documents that are not held out, beside at most ``OTHER_ROWS`` without a label.
Every word or beginning that passes the test stands for itself or, where a shorter beginning of it is the better voter, is
covered by that one. A voter counts once however long the text, so one insult in a long document weighs as much as in a
short one. Learning and scoring split words alike: lower case in all scripts, at all that is no letter or digit.

Defined cases: a null or empty text has no votes but that of absence; where the sample is too small for any word to pass
the test, as it is without labelled rows, the hand-written patterns vote with the weight they start from; repeated rows
are scored each; a null doc_id is kept and not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import held_out, sample
from .quality import score
from .shared import cut, ready, slices, tidy

#: The bounds of the sample, and the fewest toxic documents that a word or a beginning must stand in.
SAMPLE_ROWS, OTHER_ROWS, SUPPORT = 5000, 5000, 5
#: Characters of a lexicon's word, and those of a beginning (which ends in this mark).
WORD, BEGINNING, MARK = (3, 24), (4, 7), "*"
#: How often words of a beginning must stand in a text for it to vote, one voter for each number; the standard errors and
#: the log odds of the test.
TIMES, SURE, LOWEST = (1, 2, 4), 3.3, 1.5
#: The most that a given label and that a voter counts, in log odds.
TRUST, VOICE = 4.0, 6.0

#: Hand-written pattern voters over lower-cased bytes, each with literals of which a text that it matches holds one.
PATTERNS = (
    ((b"you",), rb"you(?:'re| are)? (?:all |just |such |so )?(?:an? )?(?:fool|liar|disgrace|joke|nobody|nothing)\b"),
    ((b"shut up", b"get lost", b"drop dead", b"go to hell", b"screw you"), rb"\b(?:shut up|get lost|drop dead|go to hell|screw you)\b"),
    ((b" hate ", b" despise ", b" loathe "), rb"\b(?:i|we|they) (?:really )?(?:hate|despise|loathe) (?:you|them|him|her)\b"),
    ((b"kill ", b"hurt ", b"beat ", b"punch "), rb"\b(?:kill|hurt|beat|punch) (?:you|yourself|them|him|her)\b"),
    ((b" bist ", b" seid "), rb"\b(?:du|ihr) (?:bist|seid) (?:ein |eine )?(?:idiot|trottel|dumm)"),
    ((b"eres ", b"sois "), rb"(?:eres|sois) (?:un |una )?(?:idiota|imb\xc3\xa9cil|est\xc3\xbapido)"),
    ((b"tu es ", b" \xc3\xaates "), rb"(?:tu es|vous \xc3\xaates) (?:un |une )?(?:idiot|imb\xc3\xa9cile|stupide)"),
)
_COMPILED = [(literals, re.compile(p)) for literals, p in PATTERNS]


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts and their ends; start, stop and text number of each word."""
    data, ends = K.flat(pc.utf8_lower(texts.cast(pa.large_string())))
    data = K.plain(data)
    return data, ends, *K.words(data, ends, K.BREAK)


def _hashes(words: list[str]) -> np.ndarray:
    data = [np.frombuffer(w.encode(), np.uint8) for w in words]
    return np.array([K.word_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in data], dtype=np.uint64)


@dataclass(frozen=True)
class Voters:
    lexicon: tuple[str, ...]
    beginnings: tuple[str, ...] = ()

    @property
    def induced(self) -> int:
        return len(self.lexicon) + len(self.beginnings)

    def _hits(self, known: list[str], n: int, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often each of the known words stands in each of the n texts."""
        own = _hashes(known)
        order = np.argsort(own)
        h = K.word_hashes(data, starts, stops)
        at = np.minimum(np.searchsorted(own[order], h), len(own) - 1)
        hit = own[order][at] == h
        return np.bincount(doc[hit] * len(own) + order[at[hit]], minlength=n * len(own)).reshape(n, len(own))

    def votes(self, texts: pa.Array) -> np.ndarray:
        """0/1 of each text and voter: words, beginnings, hand-written patterns, and last that no induced voter fires."""
        out = np.zeros((len(texts), self.induced + len(_COMPILED) + 1), dtype=np.float32)
        data, ends, starts, stops, doc = _split(texts)
        lengths = np.zeros(256, dtype=bool)
        lengths[[min(255, len(w.encode())) for w in self.lexicon]] = True
        like = lengths[np.minimum(stops - starts, 255)]
        if self.lexicon:
            out[:, : len(self.lexicon)] = self._hits(list(self.lexicon), len(texts), data, starts[like], stops[like], doc[like]) > 0
        words = [b.rstrip(MARK) for b in self.beginnings]
        sizes = np.array([len(w.encode()) for w in words], dtype=np.int64)
        times = np.array([len(b) - len(w) for b, w in zip(self.beginnings, words, strict=True)], dtype=np.int64)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            known = sorted({words[i] for i in at})
            like = stops - starts > n
            found = self._hits(known, len(texts), data, starts[like], starts[like] + n, doc[like])
            out[:, len(self.lexicon) + at] = found[:, [known.index(words[i]) for i in at]] >= times[at]
        whole = data.tobytes()
        for j, (literals, pattern) in enumerate(_COMPILED):
            for m in pattern.finditer(whole) if any(x in whole for x in literals) else ():
                out[np.searchsorted(ends, m.start()), self.induced + j] = 1
        out[:, -1] = out[:, : self.induced].sum(axis=1) == 0
        return out


def terms(text: str | None) -> set[str]:
    """Words of a text and beginnings of its words, with as many marks as they are there at least, from which voters are
    induced."""
    data, _, starts, stops, _ = _split(pa.array([text or ""]))
    whole, found = data.tobytes(), Counter()
    out: set[str] = set()
    for w, n in Counter(whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)).items():
        word = w.decode("utf-8", "replace")
        if WORD[0] <= len(word) <= WORD[1]:
            out.add(word)
        for k in range(BEGINNING[0], min(BEGINNING[1], len(word) - 1) + 1):
            found[word[:k]] += n
    out.update(w + MARK * t for w, n in found.items() for t in TIMES if n >= t)
    return out


def induce(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Voters:
    """Words and beginnings much likelier in toxic documents, by a lower bound of the log odds of a document that holds them
    less those of any. ``counts``: of each, the toxic and the clean documents that hold it. One that a better beginning covers gives way to it."""
    passed = {}
    for w, a, b in counts:
        n, share = a + b, a / (a + b)
        middle, half = share + SURE**2 / 2 / n, SURE * np.sqrt(share * (1 - share) / n + SURE**2 / 4 / n**2)
        least = (middle - half) / (1 + SURE**2 / n)  # Wilson's bound of the share that is toxic
        low = np.log(least / (1 - least)) - np.log((toxic + 0.5) / (clean + 0.5)) if 0 < least < 1 else -np.inf
        if low > LOWEST:
            passed[w] = (low, len(w))
    best = set()
    for w in passed:
        word = w.rstrip(MARK)
        cover = (word[:k] + MARK * t for k in range(BEGINNING[0], len(word) + (word != w)) for t in TIMES)
        best.add(max([w, *(x for x in cover if x in passed)], key=lambda x: (passed[x], x)))
    same = lambda w, x: x != w and x.startswith(w.rstrip(MARK)) and passed[x][0] >= passed[w][0]
    best -= {w for w in best if w.endswith(MARK) and any(same(w, x) for x in best)}
    words = (sorted(w for w in best if w.endswith(MARK) == ends) for ends in (False, True))
    return Voters(*map(tuple, words))


@dataclass(frozen=True)
class Posterior:
    toxic: np.ndarray  # of each row
    gain: np.ndarray  # each voter's evidence, in log odds
    prior: float


def label_model(votes: np.ndarray, labels: np.ndarray, induced: int, rounds: int = 40) -> Posterior:
    """Fit the hidden class behind the votes by expectation maximisation with correlation discounts.

    ``labels``: 0, 1 or nan. A voter's rates start from two in a hundred toxic and two in a thousand clean documents, with
    the weight of two documents. No toxic voter counts for the clean class, nor the voter of absence, last, for the
    toxic one; it follows from the others and takes no part in the correlations.
    """
    v = votes.astype(np.float64)
    known = ~np.isnan(labels)
    start = np.tile([[0.002], [0.02]], v.shape[1])
    start[:, -1] = [0.95, 0.5]
    start[:, -1] = start[:, -1] if induced else 0.5
    share = float(np.clip(labels[known].mean(), 0.01, 0.99)) if known.any() else 0.05
    p = np.where(known, 0.05 + 0.9 * np.nan_to_num(labels), share)
    weight = np.where(known, 1.0, 0.0)  # the first round's rates are those of the labelled rows
    gain, prior = np.log(start[1] / start[0]), np.log(share / (1 - share))
    for turn in range(rounds):
        mass = np.stack([weight * (1 - p), weight * p])
        total = mass.sum(axis=1, keepdims=True)
        rate = (mass @ v + 2 * start) / (total + 2)  # of each class and voter
        share = float((mass[1].sum() + 0.05) / (mass.sum() + 1))
        shared = np.zeros((v.shape[1], v.shape[1]))
        for c in (0, 1):
            off = (v - rate[c]) * np.sqrt(mass[c])[:, None]
            cov = off.T @ off / max(1e-9, float(total[c, 0]))
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-4))
            shared += float(total[c, 0]) / max(1e-9, float(total.sum())) * np.maximum(0, cov / np.outer(sd, sd))
        np.fill_diagonal(shared, 0)
        shared[-1] = shared[:, -1] = 0
        gain = np.log(rate[1] / rate[0]) / (1 + np.where(shared > 0.1, shared, 0).sum(axis=1))
        gain[:-1], gain[-1] = np.clip(gain[:-1], 0, VOICE), np.clip(gain[-1], -VOICE, 0)
        truth = [float((weight * known * np.where(labels == c, [1 - p, p][c], 0)).sum() + 1) / float((weight * known * [1 - p, p][c]).sum() + 2) for c in (0, 1)]
        say = np.where(labels == 1, np.log(truth[1] / (1 - truth[0])), np.where(labels == 0, np.log((1 - truth[1]) / truth[0]), 0.0))
        prior = np.log(share / (1 - share))
        fresh = 1 / (1 + np.exp(-np.clip(prior + v @ gain + np.clip(say, -TRUST, TRUST), -30, 30)))
        if turn and np.abs(fresh - p).max(initial=0) < 1e-4:
            break
        p, weight = fresh, np.ones(len(v))
    return Posterior(p, gain, float(prior))


@dataclass(frozen=True)
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        return self.voters.votes(texts) @ self.weights + self.bias


def linear(votes: np.ndarray, labels: np.ndarray, start: np.ndarray, bias: float, ridge: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by Newton's method, drawn towards the weights it starts from."""
    x = np.hstack([votes, np.ones((len(votes), 1))]).astype(np.float64)
    w = first = np.append(start, bias).astype(np.float64)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) / len(x) + ridge * (w - first)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, grad)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, others: int = OTHER_ROWS, support: int = SUPPORT, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Induce voters, fit the label model, and train the classifier on its posteriors."""
    ready(docs.sparkSession)
    chosen = cut(sample(docs, labels, label, rows, id_column, text_column, others), "sample")
    told = chosen.where("label is not null").groupBy("text").agg(F.max("label").alias("label"))  # copies tell a word once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[y].update(terms(text))
        words = sorted(held[0].keys() | held[1].keys())
        for at in range(0, len(words), 1 << 16):
            some = words[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([held[c][w] for w in some], pa.int64()) for c in (1, 0))], names=["w", "a", "b"])

    n = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    counts = told.select("label", "text").mapInArrow(tidy(count), "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    likely = counts.where((F.col("a") >= support) & (F.col("a") * clean > F.col("b") * 2 * toxic))  # of the bounded sample
    voters = induce([tuple(r) for r in likely.collect()], toxic, clean)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = voters.votes(part.column("text")).astype(np.int8)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "label", "votes"])

    table = chosen.select("doc_id", "label", "text").mapInArrow(tidy(vote), "doc_id string, label int, votes binary").toArrow().sort_by("doc_id")
    votes = np.frombuffer(b"".join(table.column("votes").to_pylist()), np.int8).reshape(table.num_rows, -1 if table.num_rows else voters.induced + len(PATTERNS) + 1)
    truth = table.column("label").cast(pa.float64()).to_numpy()
    found = label_model(votes, truth, voters.induced)
    weights, bias = linear(votes, found.toxic, found.gain, found.prior)
    return Model(voters, weights, bias)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    ready(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, 0.7).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

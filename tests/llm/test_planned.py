"""Best-fit packing, the filter audit and conversation repair against brute force and SQL."""

import bisect
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import audit, bestfit, repair
from tidewell.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.001"


def piece_by_piece(counts, capacity):
    """Best fit decreasing, one piece after another: the room left in each sequence."""
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            at = bisect.bisect_left(rooms, size)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - size)
    return rooms


def test_best_fit_over_counts_is_best_fit():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([10, 37, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(0, 20))}
        patterns = bestfit.best_fit(counts, capacity)
        assert sorted(capacity - sum(s * k for s, k in p) for p, n in patterns for _ in range(n)) == piece_by_piece(counts, capacity)
        plan = bestfit.slots(patterns)
        assert all(sum(k * n for p, n in patterns for s, k in p if s == size) == counts[size] for size in counts)
        assert len(plan["rank"]) <= 4 * 64 * (len(counts) + 1)
    big = {size: 10**9 + size for size in range(1, 2049)}
    assert sum(n for _, n in bestfit.best_fit(big, 2048)) < 1.02 * sum(s * n for s, n in big.items()) / 2048
    with pytest.raises(ValueError):
        bestfit.best_fit({11: 1}, 10)


def packed_right(rows, texts, most=2048):
    encode, got, places = WordEncoder()._whole, [], {}
    for r in rows:
        assert 0 < r["length"] <= most and r["piece"] * most == r["start"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"]))
    for each in places.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
        assert at <= most
    want = []
    for i, text in texts:
        ids = encode(text or "") + bytes(4)
        want += [(i, at // 4, len(ids[at : at + 4 * most]) // 4, zlib.crc32(ids[at : at + 4 * most])) for at in range(0, len(ids), 4 * most)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    counts = {}
    for x in got:
        counts[x[2]] = counts.get(x[2], 0) + 1
    assert len(places) == len(piece_by_piece(counts, most))


def test_best_fit_packs_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed_right(bestfit.op11_best_fit(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    texts = [(1, None), (1, None), (1, ""), (None, "a b"), (None, "a b"), (3, "x " * 5000), (3, "x " * 2047), (4, "x " * 2048), (5, "one"), (6, "two")]
    odd = spark.createDataFrame([(i, t, 1, "r", 0) for i, t in texts], "doc_id long, text string, rank int, `__file` string, length int").repartition(3)
    packed_right(bestfit.pack(odd).collect(), texts)
    assert bestfit.pack(odd.where("false")).count() == 0
    rows = bestfit.pack(odd, length=16, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] <= 16 for r in rows)


def test_a_common_length_is_ranked_over_many_files(spark):
    docs = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    rows = bestfit.pack(docs, length=9).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4000 and len({r["sequence_id"] for r in rows}) == 2000


def by_hand(docs, labels):
    """The audit by applying every filter to every document in every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        bad = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        rows.append((lang or "", {x for x, b in zip("ABCDE", bad, strict=True) if b}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                kept = [r for r in left if x not in r[1]]
                fails = [r for r in mine if x in r[1]]
                out[part, order, step] = [len(kept), len(gone), len(fails) - len(gone), sum(r[1] == {x} for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone), x]
                shapley[x] += len(gone)
                left = kept
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture()
def odd_docs():
    rng = random.Random(2)
    long = " ".join(f"w{i}" for i in range(30000))
    texts = [None, "", "a b", "A B C #", long, long + " x", long.replace("w29999", "w2999y"), " ".join(f"t{i}" for i in range(120)), "x " * 150, "Ä" * 300, "\x1c  a"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    return docs, [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 0, 0), (None, 1, 1), (7, 1, None), (7, 1, 1)]


@pytest.mark.parametrize("collide", [False, True])
def test_filter_audit_by_hand(spark, odd_docs, monkeypatch, collide):
    if collide:  # texts of one length then have the same hashes, so that only whole texts tell them apart
        monkeypatch.setattr(audit, "hashed", lambda rows: rows.withColumns({k: F.length("text") % 3 if k == "chars" else F.lit(0) for k in audit.KEYS}))
    rows, known = odd_docs
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id int, text string, lang string, part string, n int, chars int")
    labels = spark.createDataFrame([(*r, 5) for r in known], "doc_id int, quality int, toxic int, n int")
    got = audit.interactions(audit.counted(docs, labels)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in got} == by_hand(rows, known)
    assert audit.interactions(audit.counted(docs.where("false"), labels)).count() == 0


def test_filter_audit_sql_agrees_by_hand(odd_docs):
    rows, known = odd_docs
    con = duckdb.connect()
    con.execute("create table documents (doc_id int, text varchar, lang varchar); create table labels (doc_id int, quality int, toxic int)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    con.executemany("insert into labels values (?, ?, ?)", known)
    got = con.sql(f"select part, filter_order, step, {', '.join(COUNTS)} from ({audit.SQL})").fetchall()
    assert {r[:3]: list(r[3:]) for r in got} == by_hand(rows, known)


def best_by_search(signature):
    """All strings of edits with up to two insertions between rows that can still lead to a legal order."""
    todo = [(0, "", "", 0)]  # row, roles, edits, insertions since the last row
    costs = []
    while todo:
        i, roles, done, ins = todo.pop()
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            cost = sum({"D": 2, "I": 5}.get(e, 0) for e in done)
            rows = [e for e in done if e != "I"]
            cost += sum((e == "R") + 5 * s.isupper() for e, s in zip(rows, signature, strict=True) if e in "KR")
            costs.append((cost, done))
        if ins < 2:
            todo += [(i, roles + r, done + "I", ins + 1) for r in "ua"]
        if i < len(signature):
            s = signature[i]
            todo.append((i + 1, roles, done + "D", 0))
            if s != "x":
                todo += [(i + 1, roles + r, done + "R", 0) for r in "ua"]
                if s.lower() != "o":
                    todo.append((i + 1, roles + s.lower(), done + "K", 0))
    return min(costs)


def test_repair_is_cheapest_and_least():
    rng = random.Random(9)
    some = [""] + ["".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    for signature in some:
        layers = [repair._inserted([0, repair.NEVER, repair.NEVER, repair.NEVER])]
        for s in signature:
            layers.append(repair.layer(layers[-1], s))
        assert repair.answer(signature, layers) == best_by_search(signature)


def test_shared_prefixes_are_computed_once(spark, monkeypatch):
    signatures = ["", "suau", "sua", "suauaX".replace("X", "x"), "ua", "uauaU", "uaua", "o", "x" * 400]
    got = {r["signature"]: (r["cost"], r["audit"]) for r in repair.solved(spark.createDataFrame([(x,) for x in signatures * 3], "signature string")).collect()}
    assert got.keys() == set(signatures) and got["x" * 400] == (800, "D" * 400) and got["ua"] == (0, "KK")
    assert got["suau"] == min(best_by_search("suau"), (9, ""))


CASES = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 5, "user", "cut off"), (1, None, "user", "first!"),
    (2, None, None, None), (2, None, "user", None), (3, 1, "tool", "Out."), (3, 2, "", "No role."), (None, 1, "user", "x."), (None, None, "assistant", "y."),
    *[(4, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(200)], (5, 9, "user", "z." * 50000), (6, 1, "user", " \t"), (7, -3, "assistant", "a.\x0b"), (7, 10**12, "user", "b! "),
]


def test_repair_like_sql(spark):
    for rows in (CASES, CASES[:6] * 2, []):
        turns = spark.createDataFrame([(*r, "x", 3, "k") for r in rows], "conv_id long, turn long, role string, text string, gone string, n int, audit string")
        con = duckdb.connect()
        con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
        if rows:
            con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
        got = repair.repair(turns)
        want = con.sql(repair.SQL).project(", ".join(got.columns)).fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) == len({r[0] for r in rows})


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_structure_repair"])
def test_oracle(spark, name):
    from tidewell.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name]).project(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import edition as E
from tidewell.operators import layout, merging, moderation
from tidewell.operators.store import Store
from tidewell.plans import catalogue, digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cell_rows", [7, 1000])
def test_states_of_messages(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(moderation, "BLOCK", 3)
    rng = random.Random(3)
    kinds = [*[k for k in moderation.STEPS if k != "delete"] * 5, "delete", "other", None]
    events = [(rng.choice([1, 1, 1, 2, 3, None]), n, rng.choice(kinds)) for n in range(120)]
    events += [(4, 5, "reject"), (4, 5, "accept"), (5, None, "accept")]
    state, want = {}, []
    for m, n, e in sorted((x for x in events if x[1] is not None), key=lambda x: (x[1], x[2] or "")):
        before = state.get(m, "pending")
        state[m] = moderation.STEPS.get(e, {}).get(before, before)
        want.append((m, n, e, before, state[m], state[m] != before))
    rows = spark.createDataFrame(rng.sample(events * 2, 2 * len(events)), "message_id long, seq long, event string")
    assert sorted(map(repr, map(tuple, moderation.steps(rows, cell_rows).collect()))) == sorted(map(repr, want))
    assert moderation.steps(rows.where("false")).count() == 0
    messages = spark.createDataFrame([(m, url) for m in (1, 2, 3, 4, 9) for url in ("https://t.me/a/1", "https://t.me/a", None)], "message_id long, source_url string")
    for r in moderation.eligible(messages, moderation.steps(rows, cell_rows)).collect():
        now = state.get(r["message_id"], "pending")
        assert r["state"] == now and r["refused"] == (now if now != "accepted" else None if r["source_url"] == "https://t.me/a/1" else "link")


def test_fields_set_by_hand(spark):
    day = lambda n: datetime(2026, 9, n)
    log = [
        (1, day(1), "set", 1, "manual_title", "first", None),
        (2, day(3), "set", 1, "manual_title", "second", None),
        (3, day(4), "undo", None, None, None, 2),
        (4, day(5), "redo", None, None, None, 2),
        (5, day(6), "undo", None, None, None, 2),
        (6, day(2), "set", 1, "excluded_reason", None, None),
        (7, day(7), "undo", None, None, None, 8),  # before the set that it names
        (8, day(8), "set", 2, "manual_category", "there", None),
        (9, day(2), "set", 7, "manual_title", "no such entry", None),
        (10, day(2), "set", 2, "price", "no such field", None),
        (None, day(9), "set", 2, "manual_title", "no id", None),
        (11, None, "set", 2, "manual_title", "no instant", None),
    ]
    rows = [(a, t, k, "2026-09", m, f, v, to) for a, t, k, m, f, v, to in log]
    random.Random(1).shuffle(rows)
    actions = spark.createDataFrame(rows + rows[:4], "action_id long, at timestamp, kind string, period_key string, message_pk long, field string, value string, target long")
    entries = spark.createDataFrame([("2026-09", i, 0.5, "own", "own", "own") for i in (1, 2)], "period_key string, message_pk long, value double, manual_title string, manual_category string, excluded_reason string")

    def at(instant):
        found = moderation.acted(entries, actions, instant)
        assert found.columns == entries.columns
        return {r["message_pk"]: (r["manual_title"], r["manual_category"], r["excluded_reason"]) for r in found.collect()}

    assert at("2026-08-31") == {1: ("own",) * 3, 2: ("own",) * 3}
    assert [at(f"2026-09-0{n}")[1][0] for n in range(1, 8)] == ["first", "first", "second", "first", "second", "first", "first"]
    assert at(None) == {1: ("first", "own", None), 2: ("own", "there", "own")}


def _merged(rows, small):
    name = {(p, c): c for p, c, _ in rows}
    while True:
        sizes, words = {}, {}
        for p, c, title in rows:
            key = (p, name[p, c])
            sizes[key] = sizes.get(key, 0) + 1
            words.setdefault(key, set()).update((title or "").lower().split())
        rank = {k: (k[0], -n, k[1]) for k, n in sizes.items()}
        moves = {}
        for k, n in sizes.items():
            others = [x for x in sizes if x[0] == k[0]]
            holders = {w: [x for x in others if w in words[x]] for w in words[k]}
            shared = sorted((len(h), w) for w, h in holders.items() if len(h) > 1)
            best = [min(holders[w], key=rank.get) for _, w in shared if min(holders[w], key=rank.get) != k]
            to = (best[0] if best else k) if shared else min(others, key=rank.get)
            if n <= small and to != k:
                moves[k] = to
        if not moves:
            return {(p, c, name[p, c]) for p, c in name}

        def last(k, moves=moves):
            while k in moves:
                k = moves[k]
            return k

        name = {(p, c): last((p, n))[1] for (p, c), n in name.items()}


def test_small_categories_are_merged(spark):
    rng = random.Random(8)
    rows = [(f"m{rng.randrange(3)}", f"c{min(rng.randrange(40), rng.randrange(40))}", " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(4)))) for _ in range(160)]
    rows += [("x", "alone", "a"), ("y", "a", None), ("y", "b", "q"), ("z", "a", "one two"), ("z", "b", "two"), ("z", "b", "six"), ("z", "b", "ten")]
    df = spark.createDataFrame([*rows, ("x", None, "a"), (None, "x", "a")], "period_key string, category string, title string")
    want = _merged(rows, 2)
    assert {("y", "b", "a"), ("z", "a", "b"), ("x", "alone", "alone")} <= want
    for parts in (1, 5):
        got = list(map(tuple, merging.merged(df.repartition(parts)).collect()))
        assert len(got) == len(want) and set(got) == want
    assert merging.merged(df.where("false")).count() == 0


def test_merged_categories_by_brute_force(spark):
    got = list(map(tuple, catalogue.merged_categories(spark, SF).collect()))
    d = E.by_rule(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source", F.col("text").alias("source_text")))
    rows = [(r["lang"], f"{r['source']}/{r['doc_id'] // 3}", r["title"]) for r in d.collect()]
    assert len(got) == len(set(got)) and set(got) == _merged(rows, 2)


def _paged(blocks, limit, month):
    foot = layout.footer("b", "u")
    for digits in range(1, 9):
        parts = []
        for i, block in enumerate(blocks):
            block += foot * (i == len(blocks) - 1)
            head = lambda part, total: (f"📚 <b>b</b>\nГлавное за {month} · Часть " if part == 1 else f"📚 <b>b</b> · {month}\nЧасть ") + f"{part} из {total}\n\n"
            if parts and len(head(len(parts), "9" * digits)) + len(parts[-1]) + 2 + len(block) <= limit:
                parts[-1] += "\n\n" + block
            else:
                parts.append(block)
        if len(str(len(parts))) <= digits:
            return [head(i, len(parts)) + x for i, x in enumerate(parts, 1)]


def test_headers_and_the_number_of_parts_fit(spark):
    rng, rows, want, totals = random.Random(2), [], {}, set()
    cases = [[60] * n for n in (1, 2, *range(15, 23), *range(194, 204))] + [[rng.randrange(1, 90) for _ in range(n)] for n in (5, 12, 17, 150, 160, 180)]
    cases += [[n] * 19 + [rng.randrange(1, n)] for n in range(66, 78)] + [[58] * 17 + [200, 59], [500]]
    for k, sizes in enumerate(cases):
        period = f"20{k:02}-{k % 12 + 1:02}"
        blocks = [chr(97 + i % 26) * n for i, n in enumerate(sizes)]
        rows += [(period, i * 3, b) for i, b in enumerate(blocks)]
        want[period] = _paged(blocks, 190, f"{layout.MONTHS[k % 12]} 20{k:02}")
        totals.add(len(want[period]))
    df = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "period_key string, ord int, block string")
    got = {}
    for r in layout.paged(df, 190, "b", "u").orderBy("period_key", "part_no").collect():
        got.setdefault(r["period_key"], []).append(r["html"])
        assert r["total"] == len(want[r["period_key"]]) and r["part_no"] == len(got[r["period_key"]])
    assert got == want and {9, 10, 11, 99, 100, 101} <= totals
    assert layout.paged(df.where("false")).count() == 0
    assert T.LIMIT == 3700


def _stored(spark, tmp_path, texts):
    store = Store(spark, str(tmp_path / "store"))
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"messages": [{"type": "message", "id": i, "date": "2026-09-02T00:00:00", "text": t} for i, t in texts]}))
    digest.import_export(spark, store, str(path), "2026-09", "c", "u")
    return store


def test_edits_by_hand_reach_the_next_edition(spark, tmp_path):
    store = _stored(spark, tmp_path, [(1, "sofa"), (2, "rent")])
    first = digest.act(store, "2026-09", "ann", "set", 1, "manual_title", "A sofa")
    digest.act(store, "2026-09", "ann", "set", 2, "excluded_reason", "spam")
    second = digest.act(store, "2026-9", "bo", "set", 1, "manual_title", "Two sofas")
    asked = []
    with pytest.raises(RuntimeError):
        digest.classify(spark, store, "2026-09", {"a": lambda text: asked.append(text) or "{}"})
    assert "rent" in asked[0] and "sofa" not in asked[0]
    part = lambda: digest.render(store, "2026-09")[0]
    assert "Two sofas" in part() and "/2\"" not in part()
    pinned = digest.pinned(store, "2026-09", "here")[0]["html"]
    digest.act(store, "2026-09", "bo", "undo", target=second)
    assert "A sofa" in part() and "Two sofas" in pinned
    digest.act(store, "2026-09", "bo", "redo", target=second)
    assert "Two sofas" in part()
    digest.act(store, "2026-09", "bo", "undo", target=second)
    digest.act(store, "2026-09", "bo", "undo", target=first)
    assert "sofa" not in part() and digest.pinned(store, "2026-09", "here")[0]["html"] == pinned
    before = store.version()
    for bad in (("set", 9, "manual_title"), ("set", 1, "provider"), ("undo", None, None, None, 99), ("drop", 1)):
        with pytest.raises(ValueError):
            digest.act(store, "2026-09", "bo", *bad)
    assert store.version() == before
    assert store.read("entries", "2026-09").where("manual_title is not null").isEmpty()  # the log is beside the entries


def test_classification_by_rules(spark, tmp_path):
    store = _stored(spark, tmp_path, [(1, "sofa  blue"), (2, "rent a flat by the sea in the old town"), (3, "sofa blue"), (4, "flat"), (5, "bed")])

    def answers(text):
        rows = json.loads(text.splitlines()[-1])
        asked.append([r["id"] for r in rows])
        return json.dumps({"categories": [{"code": c, "title": c.upper()} for c in "hsb"], "entries": [{"id": r["id"], "include": True, "category": {"r": "h", "f": "h", "b": "b"}.get(r["text"][0], "s"), "title": r["text"]} for r in rows]})

    asked = []
    assert digest.classify_by_rules(spark, store, "2026-09", {"a": lambda text: "no"}) == "rules" and store.read("results").isEmpty()
    titles = lambda c="short_title": {r["message_pk"]: r[c] for r in store.read("entries", "2026-09").collect()}
    assert titles() == {1: "sofa blue", 2: "rent a flat by the sea in the old", 3: "sofa blue", 4: "flat", 5: "bed"} and set(titles("category_title").values()) == {T.NO_CATEGORY}
    assert digest.classify_by_rules(spark, store, "2026-09", {"a": answers}) == "a"
    assert asked == [[1, 2, 4, 5]]  # one of two like texts
    # all three categories are small; none shares a word with another, so they go into the first of the largest
    assert set(titles("category_code").values()) == {"h"} and set(titles("category_title").values()) == {"H"}
    assert {r["category"] for r in store.read("results").collect()} == {"h", "s", "b"}
    assert digest.classify_by_rules(spark, store, "2026-09", {"a": answers}) == "cache" and len(asked) == 1
    path = tmp_path / "more.json"
    path.write_text(json.dumps({"messages": [{"type": "message", "id": i, "date": "2026-09-03T00:00:00", "text": t} for i, t in [(6, "bed"), (7, "lamp")]]}))
    digest.import_export(spark, store, str(path), "2026-09", "c", "u")
    assert digest.classify_by_rules(spark, store, "2026-09", {"a": answers}) == "a" and asked[1] == [7]
    assert titles()[6] == "bed" and titles()[7] == "lamp"
    parts = digest.render(store, "2026-09", "b", "https://t.me/u")
    assert len(parts) == 1 and parts[0].startswith("📚 <b>b</b>\nГлавное за сентябрь 2026 · Часть 1 из 1\n\n") and parts[0].endswith('<a href="https://t.me/u">b</a></b>')


def test_pages_of_a_large_month_in_one_pass(spark):
    rng = random.Random(8)
    lines = ["", "", *("x" * rng.choice([0, 1, 9, 40, 90]) for _ in range(12000))]
    rows = spark.createDataFrame([("2024-03", "*", "c", i, x) for i, x in enumerate(lines)], "period_key string, emoji string, category string, rank int, line string")
    blocks = E.split_blocks(rows, 80)
    bodies, room = [], 80 - len(f"* <b>c{E.MORE}</b>\n")
    for x in lines:
        if bodies and (not bodies[-1] or len(bodies[-1]) + 1 + len(x) <= room):
            bodies[-1] += "\n" * bool(bodies[-1]) + x
        else:
            bodies.append(x)
    want = [f"* <b>c{E.MORE if k else ''}</b>\n{b}" for k, b in enumerate(bodies)]
    got = [r["block"] for r in blocks.orderBy("ord", "piece").collect()]
    assert got == want and len(want) > 3000
    parts = layout.paged(blocks.select("period_key", F.struct("ord", "piece").alias("ord"), "block"), 190, "b", "u")
    assert [r["html"] for r in parts.orderBy("part_no").collect()] == _paged(want, 190, "март 2024")
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # a fold copies what it has found at every step

"""The documents' rules in the commands: import with albums, edits and a zone, classification by album, warnings."""

import json
import unicodedata
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell import cli
from tidewell.operators import edition as E
from tidewell.operators.store import Store
from tidewell.plans import digest
from tidewell.sources import export
from tidewell.streaming import live

MONTH = "2026-09"


def item(n, date="2026-09-02T10:00:00", text="", **more):
    return {"type": "message", "id": n, "date": date, "text": text, **more}


def bring(spark, store, tmp_path, *items, zone="Europe/Madrid"):
    path = tmp_path / f"export{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps({"messages": items}))
    return digest.import_by_rules(spark, store, str(path), "2026-9", "1", "u", zone)


def seen(store):
    """By message id: text and why it is not shown."""
    m = {r["id"]: r for r in store.read("messages", MONTH).collect()}
    rows = store.read("entries", MONTH).collect()
    assert len(rows) == len(m)
    return {m[r["message_pk"]]["message_id"]: (m[r["message_pk"]]["source_text"], r["excluded_reason"]) for r in rows}


def test_the_month_is_that_of_the_zone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    items = [
        item(1, "2026-08-31T23:59:59", "august"), item(2, "2026-09-01T00:00:00", "first"), item(3, "2026-09-30T23:59:59", "last"), item(4, "2026-10-01T00:00:00", "october"),
        item(5, "2026-08-31T22:30:00", "by the clock", date_unixtime="1788215400"),  # 22:30 in UTC on the 31st, and so the first in Madrid
        item(6, "2026-09-03", "a day"), item(7, "no date", "none"), item("8", text="bad id"), {**item(9, text="x"), "type": "service"},
    ]
    assert bring(spark, store, tmp_path, *items) == 4
    assert {n: x[0] for n, x in seen(store).items()} == {2: "first", 3: "last", 5: "by the clock", 6: "a day"}
    assert {r["message_id"]: r["published_at"] for r in store.read("messages", MONTH).collect()}[2] == "2026-08-31T22:00:00"
    with pytest.raises((PySparkException, Py4JJavaError)):
        bring(spark, store, tmp_path, item(1, "2026-09-01T00:00:00Z", "offset"))


def test_nothing_and_nobody(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert bring(spark, store, tmp_path) == 0 and store.version() == 0
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"messages": [item(1, text="a")]}))
    with pytest.raises(ValueError):
        digest.import_by_rules(spark, store, str(path), MONTH, "1", "")
    assert digest.warnings(store, MONTH).isEmpty()


def test_edits_are_taken_and_classified_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = lambda d: f"2026-09-0{d}T10:00:00"
    assert bring(spark, store, tmp_path, item(1, text="sofa", **{"from": "Ann"}, media_type="photo"), item(2, text=" ", edited=day(3)), item(3, text="café  bar")) == 3
    assert seen(store) == {1: ("sofa", None), 2: ("", "needs_review"), 3: ("café bar", None)}
    facts = {r["message_id"]: (r["sender_name"], r["media_type"], r["source_url"]) for r in store.read("messages").collect()}
    assert facts[1] == ("Ann", "photo", "https://t.me/u/1") and facts[2][:2] == ("", None)
    titled = store.read("entries", MONTH).withColumns({"short_title": F.lit("old"), "manual_title": F.lit("mine")})
    store.commit(store.version(), {("entries", MONTH): titled})
    # an edit, a text that came later, and a version from before the first import's
    bring(spark, store, tmp_path, item(1, text="sofa, sold", edited=day(4)), item(2, text="a text", edited=day(5)), item(3, text="café bar"))
    bring(spark, store, tmp_path, item(1, text="sofa"), item(2, text="older", edited=day(4)))
    assert seen(store) == {1: ("sofa, sold", None), 2: ("a text", None), 3: ("café bar", None)}
    titles = {r["message_pk"]: (r["short_title"], r["manual_title"]) for r in store.read("entries", MONTH).collect()}
    assert sorted(titles.values(), key=str) == [("old", "mine"), (None, "mine"), (None, "mine")]
    before = sorted(map(str, store.read("entries", MONTH).collect()))
    bring(spark, store, tmp_path, item(1, text="sofa, sold", edited=day(4)), item(2, text="a text", edited=day(5)))
    assert sorted(map(str, store.read("entries", MONTH).collect())) == before
    # the live stream has a newer version than the next export
    said = spark.createDataFrame([(MONTH, "1", 1, datetime(2026, 9, 2), datetime(2026, 9, 20), 77, "sofa again", None, False)], "period_key string, chat_id string, message_id long, sent_at timestamp, at timestamp, update_id long, words string, media_group_id string, deleted boolean")
    assert live.upsert(store, said, "u")
    bring(spark, store, tmp_path, item(1, text="sofa, sold", edited=day(4)))
    assert seen(store)[1][0] == "sofa again"


def test_a_plain_import_goes_on_by_rules(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "store")), tmp_path / "plain.json"
    path.write_text(json.dumps({"messages": [item(1, text="a  b"), item(2, text="c", media_group_id="g"), item(3, text="d", media_group_id="g")]}))
    digest.import_export(spark, store, str(path), MONTH, "1", "u")
    store.commit(store.version(), {("entries", MONTH): store.read("entries", MONTH).withColumn("short_title", F.lit("old"))})
    digest.import_by_rules(spark, store, str(path), MONTH, "1", "u")
    assert {n: why for n, (_, why) in seen(store).items()} == {1: None, 2: None, 3: "album"}
    assert {r["message_pk"]: r["short_title"] for r in store.read("entries", MONTH).collect()} == {1: "old", 2: "old", 3: "old"}  # no text changed


def test_an_album_has_one_entry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    of = lambda n, text="", g="g", **more: item(n, text=text, media_group_id=g, **more)
    bring(spark, store, tmp_path, of(5), of(6, "flat by the sea"), of(7, "second text"), of(8, g="h"), of(9, g="h"), item(10, text="bike"))
    assert {n: why for n, (_, why) in seen(store).items()} == {5: None, 6: "album", 7: "album", 8: "needs_review", 9: "album", 10: None}
    pk = {r["message_id"]: r["id"] for r in store.read("messages", MONTH).collect()}
    asked = []

    def answers(text):
        rows = json.loads(text.splitlines()[-1])
        asked.append({r["id"]: r["text"] for r in rows})
        return json.dumps({"categories": [{"code": "c", "title": "C"}], "entries": [{"id": r["id"], "include": True, "category": "c", "title": r["text"]} for r in rows]})

    assert digest.classify_by_rules(spark, store, MONTH, {"a": answers}) == "a"
    assert asked == [{pk[5]: "flat by the sea", pk[10]: "bike"}]
    part = digest.render(store, MONTH)[0]
    assert part.count("•") == 2 and 'flat by the sea <a href="https://t.me/u/5">' in part
    # the album's text is edited, so its entry is classified anew, though the entry's own message did not change
    bring(spark, store, tmp_path, of(6, "flat, taken", edited="2026-09-05T00:00:00"))
    assert {r["message_pk"]: r["short_title"] for r in store.read("entries", MONTH).collect()}[pk[5]] is None
    digest.classify_by_rules(spark, store, MONTH, {"a": answers})
    assert asked[1:] == [{pk[5]: "flat, taken"}]
    # its first two messages are deleted: the third stands for it; and the other album gets a text
    gone = json.dumps({"update_id": 90, "deleted_business_messages": {"chat": {"id": 1}, "message_ids": [5, 6]}})
    kind = f"{live.UPDATE}, {live.DELETION}"
    live.upsert(store, live.changes(spark.createDataFrame([(gone,)], "j string").select(F.from_json("j", kind).alias("x")).select("x.*"), "Europe/Madrid"), "u")
    bring(spark, store, tmp_path, of(9, "a dog", "h", edited="2026-09-05T00:00:00"))
    assert {n: why for n, (_, why) in seen(store).items()} == {5: "deleted", 6: "deleted", 7: None, 8: None, 9: "album", 10: None}
    digest.classify_by_rules(spark, store, MONTH, {"a": answers})
    assert asked[2:] == [{pk[7]: "second text", pk[8]: "a dog"}]


def test_warnings(spark, tmp_path, monkeypatch, capsys):
    store = Store(spark, str(tmp_path / "store"))
    bring(spark, store, tmp_path, *[item(n, text=f"text {n}") for n in (1, 2, 3, 6, 7)], item(4))
    told = lambda: sorted(tuple(r) for r in digest.warnings(store, "2026-9").collect())
    pk = {r["message_id"]: r["id"] for r in store.read("messages", MONTH).collect()}
    title = F.when(F.col("message_pk").isin(pk[1], pk[2], pk[7]), "same").when(F.col("message_pk") == pk[3], "x" * 43)
    code = F.when(F.col("message_pk") == pk[7], "other").otherwise("one")
    store.commit(store.version(), {("entries", MONTH): store.read("entries", MONTH).withColumns({"short_title": title, "category_title": code})})
    want = [("gap", "1", 5, 5, None), ("long title", "1", 3, 3, "x" * 43), ("needs_review", "1", 4, 4, None), ("no title", "1", 6, 6, None), ("same title", "1", 1, 1, "same"), ("same title", "1", 2, 2, "same")]
    assert told() == want
    digest.act(store, MONTH, "ann", "set", pk[2], "manual_title", "another")
    digest.act(store, MONTH, "ann", "set", pk[6], "excluded_reason", "spam")
    assert told() == want[:3]
    monkeypatch.setenv("DIGEST_STORE", store.path)
    monkeypatch.setattr(spark, "stop", lambda: None)
    cli.main(["warnings", "--period", MONTH])
    assert capsys.readouterr().err.splitlines()[-3:] == ["gap\t1\t5\t5\t", "long title\t1\t3\t3\t" + "x" * 43, "needs_review\t1\t4\t4\t"]


def test_composed_form(spark):
    rows = spark.createDataFrame([("é",), (None,), ("",), ("ok",)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(E.normalised("t")).collect()] == ["é", None, "", "ok"]
    assert [r[0] for r in rows.where("t is null").select(E.normalised("t")).collect()] == [None]


def test_composed_form_needs_no_python(spark):
    texts = ["e\u0301", "\u1100\u1161\u11a8", "q\u0323\u0307", "q\u0307\u0323", "\u212b", "\u0958", "\U0001d15e", "\ufb01", "a" * 100_000 + "u\u0308"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(E.normalised(F.col("t")).alias("t"))
    assert [r[0] for r in rows.collect()] == [unicodedata.normalize("NFC", t) for t in texts]
    assert "EvalPython" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_told_keeps_messages_without_text(spark):
    rows = spark.createDataFrame([(0, json.dumps(item(1, text=None))), (1, json.dumps(item(True, text=["a", {"text": " b"}])))], "pos int, j string").select("pos", F.parse_json("j").alias("m"))
    assert [(r["message_id"], r["words"]) for r in export.told(rows, MONTH, "1", "UTC").orderBy("pos").collect()] == [(1, None), (1, "a b")]

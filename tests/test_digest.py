import io
import json
import random
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.period import canonical, month_bounds
from tidewell.operators import edition as E
from tidewell.operators import render as R
from tidewell.operators.classify import cascade, reply_object
from tidewell.operators.store import Conflict, Store, numbered
from tidewell.plans import catalogue, digest
from tidewell.sources import export
from tidewell.sources.settings import dotenv
from tidewell.streaming import live

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_scalars(spark):
    assert one(spark, T.strip(F.lit(" \x1c a b ​ "))) == "a b ​"
    assert one(spark, T.escape(F.lit("<a & \"b\" 'c'>"))) == "&lt;a &amp; &quot;b&quot; &#x27;c&#x27;&gt;"
    assert one(spark, T.scrub(F.lit("x http://a.b/c\u00a0y +34 600-123-456 HTTP://z 1234567"))) == "x \u00a0y HTTP://z 1234567"
    assert one(spark, T.first_filled(F.lit(""), F.lit(None), F.lit("z"))) == "z"
    assert month_bounds("2023-12")[1].year == 2024 and canonical("2026-9") == "2026-09"


def test_packing(spark):
    blocks = ["a" * 1849, "b" * 1849, "c" * 5000, "d"]
    got = one(spark, T.packed(F.array(*[F.lit(b) for b in blocks])))
    assert got == ["a" * 1849 + "\n\n" + "b" * 1849, "c" * 5000, "d"]
    assert one(spark, T.packed(F.array(F.lit("a" * 1850), F.lit("b" * 1849)))) == ["a" * 1850, "b" * 1849]


def test_reply():
    assert reply_object('say ```json\n{"a": 1}\n``` ok') == {"a": 1}
    assert reply_object('{"a": 1} trailing') == {"a": 1}
    assert reply_object('```json\n{"a": 1}\n```\n```\nno json\n```') == {"a": 1}
    assert reply_object('```\nno\n``` ```json {"a": "b ``` c"}``` {"z": 2}') == {"a": "b ``` c"}
    assert reply_object('```{bad}``` ```{"a": 1}') == {"a": 1}
    for text in ('leading {"a": 1}', "[1]", "", "```json\n[1]\n```"):
        with pytest.raises(ValueError):
            reply_object(text)


def test_a_refused_request_is_reported_in_the_servers_words(spark):
    def refused(text):
        raise HTTPError("http://x", 400, "Bad Request", {}, io.BytesIO(b'{"error": "quota of the model is spent"}' + b"." * 5000))

    with pytest.raises(RuntimeError, match="a: HTTP Error 400: Bad Request: .*quota") as error:
        cascade(spark, spark.range(1), {"a": refused}, "text")
    assert len(str(error.value)) == len("a: ") + 800


def test_prompt():
    text = digest.prompt([{"id": 1, "text": "è"}], "Города")
    assert text.endswith('[{"id":1,"text":"è"}]') and "не Города" in text and "не должны повторяться" in text and '"include":true' in text
    assert "не  " not in digest.prompt([]) and "None" not in digest.prompt([])


def test_dotenv(tmp_path):
    (tmp_path / ".env").write_text("# c\n\nA = 1 \nB=x=y\nno\n")
    assert dotenv(tmp_path / ".env") == {"A": "1", "B": "x=y"}


def test_commands(spark, tmp_path):
    items = [
        {"type": "message", "id": 1, "date": "2026-09-01T00:00:00", "text": "sofa"},
        {"type": "message", "id": 1, "date": "2026-09-02T00:00:00", "text": "again"},
        {"type": "message", "id": 2, "date": "2026-09-30T23:59:59", "text": ["to ", {"text": "rent"}, {"type": "x"}], "from": None},
        {"type": "message", "id": 3, "date": "2026-10-01T00:00:00", "text": "late"},
        {"type": "message", "id": "4", "date": "2026-09-03T00:00:00", "text": "bad id"},
        {"type": "service", "id": 5, "date": "2026-09-03T00:00:00", "text": "service"},
        {"type": "message", "id": 6, "date": "bad", "text": "x"},
        {"type": "message", "id": 7, "date": "2026-09-03T00:00:00", "text": "  "},
    ]
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"messages": items}))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert digest.import_export(spark, store, str(path), "2026-9", "c", "u") == 3
    rows = store.read("messages").orderBy("id").collect()
    assert [(r["id"], r["message_id"], r["source_text"], r["sender_name"]) for r in rows] == [(1, 1, "sofa", ""), (2, 2, "to rent", None)]
    reply = {"categories": [{"code": "h", "title": "Home", "emoji": "🏠"}], "entries": [{"id": 1, "include": True, "category": "h", "title": "Sofa <1>"}, {"id": 2, "include": "false", "category": "?", "title": "Rent"}]}
    providers = {"a": lambda text: "{}", "b": lambda text: json.dumps(reply)}
    assert digest.classify(spark, store, "2026-09", providers) == "b"
    parts = digest.render(store, "2026-09")
    assert len(parts) == 1 and "🏠 <b>Home</b>\n• Sofa &lt;1&gt; <a href=\"https://t.me/u/1\">↗</a>\n\n📦 <b>Другое</b>\n• Rent" in parts[0]
    with pytest.raises(RuntimeError):
        digest.classify(spark, store, "2026-09", {"a": lambda text: "{}"})


def test_numbered_by_cells(spark):
    rows = spark.range(0, 3000, 3, 5).selectExpr("2999 - id AS k")
    for cell_rows in (7, 100, 1 << 20):
        got = numbered(rows, 10, "k", cell_rows)
        assert sorted((r["id"], r["k"]) for r in got.collect()) == [(11 + i, 2 + 3 * i) for i in range(1000)]
    plan = numbered(rows, 10, "k", 100)._jdf.queryExecution().executedPlan().toString()
    assert "RDD" not in plan and "SinglePartition" not in plan
    assert numbered(spark.createDataFrame([], "k long"), 10, "k").count() == 0


def digest_store(spark, tmp_path, months=("2026-08", "2026-09")):
    store = Store(spark, str(tmp_path / "store"))
    for k, month in enumerate(months):
        assert digest.add(store, month, month_of_messages(spark, k, month), "pos") == 3
    return store


def month_of_messages(spark, k, month):
    items = [(i, json.dumps({"type": "message", "id": 10 * k + i, "date": f"{month}-0{i}T00:00:00", "text": f"text {i}"})) for i in (1, 2, 3)]
    return export.qualifying(spark.createDataFrame(items, "pos int, m string").withColumn("m", F.parse_json("m")), month, "c", "u")


def answer(prefix, ids):
    return {"fake": lambda text: json.dumps({"categories": [{"code": "c", "title": "Cat", "emoji": "x"}], "entries": [{"id": i, "include": True, "category": "c", "title": f"{prefix} {i}"} for i in ids]})}


def test_one_months_update_writes_one_partition(spark, tmp_path):
    store = digest_store(spark, tmp_path)
    files = lambda: {str(x.relative_to(tmp_path)) for x in (tmp_path / "store").glob("data/*/*")}
    before = files()
    assert store.version() == 2 and store.top() == 6 and len(before) == 4
    digest.classify(spark, store, "2026-09", answer("new", (4, 5, 6)))
    (added,) = files() - before
    assert added.startswith("store/data/entries/2026-09-") and before < files()
    assert all("/2026-09-" in x for x in store.read("entries", "2026-09").inputFiles() + store.read("messages", "2026-09").inputFiles())
    assert digest.add(store, "2026-08", month_of_messages(spark, 0, "2026-08"), "pos") == 0 and store.version() == 3  # nothing new, no version
    assert [r["short_title"] for r in store.read("entries").orderBy("message_pk").collect()] == [None] * 3 + ["new 4", "new 5", "new 6"]
    assert {r["short_title"] for r in store.read("entries", version=2).collect()} == {None}
    assert store.expire(keep=1, older=3600) == 2 and len(files()) == 5  # young folders stay
    assert store.expire(keep=1, older=0) == 1 and len(files()) == 4 and store.read("entries").count() == 6


def test_a_failed_or_late_write_changes_nothing(spark, tmp_path):
    store = digest_store(spark, tmp_path)
    names = lambda: sorted(str(x) for x in (tmp_path / "store").rglob("*") if not x.name.startswith("."))
    rows, before, base = store.read("entries", "2026-09"), names(), store.version()
    with pytest.raises(Exception, match="broken"):
        store.commit(base, {("entries", "2026-09"): rows, ("entries", "2026-08"): rows.withColumn("eligible", F.raise_error(F.lit("broken")).cast("int"))})
    assert names() == before and store.version() == base
    assert store.commit(base, {("entries", "2026-09"): rows}) == base + 1
    before = names()
    with pytest.raises(Conflict):
        store.commit(base, {("entries", "2026-09"): rows.where("false")})
    assert names() == before and store.read("entries", "2026-09").count() == 3


def test_two_writers_at_once(spark, tmp_path):
    store = digest_store(spark, tmp_path)
    base, rows = store.version(), store.read("entries", "2026-09")

    def write(k):
        try:
            return store.commit(base, {("entries", "2026-09"): rows.withColumn("provider", F.lit(str(k)))}) and k
        except Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        (won,) = [k for k in pool.map(write, range(4)) if k is not None]
    assert {r["provider"] for r in store.read("entries", "2026-09").collect()} == {str(won)} and store.version() == base + 1


def test_publishing_goes_on_with_the_pinned_edition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "LIMIT", 60)  # so that there are parts
    store, sent = digest_store(spark, tmp_path), []
    reply = lambda name: {"fake": lambda text: json.dumps({"categories": [{"code": str(i), "title": f"Cat {i}", "emoji": "x"} for i in (4, 5, 6)], "entries": [{"id": i, "include": True, "category": str(i), "title": f"{name} {i}"} for i in (4, 5, 6)]})}

    def send(token, target, html):
        if len(sent) == 1 and "failed" not in sent:
            sent.append("failed")
            raise OSError("down")
        sent.append(html)
        return {"result": {"message_id": len(sent)}}

    digest.classify(spark, store, "2026-09", reply("old"))
    want = digest.render(store, "2026-09")
    assert len(want) == 3
    with pytest.raises(OSError):
        digest.publish_rest(store, "2026-9", send, "t", "here")
    digest.classify(spark, store, "2026-09", reply("new"))
    assert digest.render(store, "2026-09") != want
    assert digest.publish_rest(store, "2026-09", send, "t", "here") == 2
    assert digest.publish_rest(store, "2026-09", send, "t", "here") == 0
    assert sent == [want[0], "failed", *want[1:]]
    assert digest.publish_rest(store, "2026-09", send, "t", "there") == 3 and "new 4" in "".join(sent[-3:])
    log = store.read("publications", "2026-09").where("destination = 'here'").orderBy("part_no").collect()
    assert [(r["part_no"], r["telegram_message_id"], r["rendered_html"]) for r in log] == [(1, 1, want[0]), (2, 3, want[1]), (3, 4, want[2])]
    store.sent("2026-08", "here", 1, 9, "from elsewhere")
    with pytest.raises(ValueError, match="another edition"):
        digest.publish_rest(store, "2026-08", send, "t", "here")
    with pytest.raises(SystemExit):
        digest.publish_rest(store, "2026-09", send, "", "here")
    assert digest.publish_rest(store, "2026-07", send, "t", "here") == 0
    bad = store.read("editions", "2026-09").withColumn("html", F.lit("changed"))
    store.commit(store.version(), {("editions", "2026-09"): bad})
    with pytest.raises(ValueError, match="damaged"):
        digest.publish_rest(store, "2026-09", send, "t", "here")


EXPORTS = [
    {"name": "x, [y]", "o": {"a": [1, {"b": 2}], "c": 3}, "messages": [1, None, "a,b", 'q"u\\o,te', "br{a]c,", {"t": ["é,中\n", {"text": ",\\"}], "n": {"k": [[], {}]}}, [1, [2]], -2.5, True], "z": [[1, 2], [3]], "w": 5},
    {"messages": [{"id": i, "text": "long, " * (i % 40)} for i in range(60)]},
    {"messages": []}, {"messages": None}, {"a": {"messages": [7]}}, {},
]
CORRUPT = ['{"messages":[1,2]', '{"messages":[1,,2]}', "[1,2]", '{"messages":{"a":1,"b":2}}', '{"messages":[{"a":1,"a":2}]}', '{"messages":[1]} x', '{"messages":[1],"b":tru}']


@pytest.mark.parametrize("size", [97, 11])
def test_export_in_byte_ranges(spark, tmp_path, size):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    listed = lambda df: [(r["pos"], r["j"]) for r in df.select("pos", F.to_json("m").alias("j")).orderBy("pos").collect()]
    try:
        for k, value in enumerate(EXPORTS[: 6 if size == 97 else 1]):
            path = tmp_path / f"{k}.json"
            path.write_text(json.dumps(value, ensure_ascii=k % 2 == 0, indent=None if k % 2 else 1))
            whole = spark.read.schema("messages array<variant>").option("multiLine", True).json(str(path)).select(F.posexplode("messages").alias("pos", "m"))
            assert listed(export.scan(spark, str(path))) == listed(whole)
        for k, text in enumerate(CORRUPT if size == 97 else CORRUPT[:1]):
            path = tmp_path / f"bad{k}.json"
            path.write_text(text)
            with pytest.raises((PySparkException, Py4JJavaError)):
                export.scan(spark, str(path)).collect()
    finally:
        spark.conf.set(key, before)


def test_live(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    message = lambda n, **more: {"message_id": n, "chat": {"id": 1}, "date": 100, **more}
    first = [{"update_id": 1, "message": message(1, text=" sofa\n for  sale ")}, {"update_id": 2, "message": message(2)}, {"update_id": 3}]
    second = [{"update_id": 1, "message": message(1, text=" sofa\n for  sale ")}, {"update_id": 4, "edited_message": message(2, edit_date=50, caption="c")}, {"update_id": 5, "edited_message": message(1, edit_date=200, text="sold")}]
    for name, rows in (("a", first), ("b", second)):
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        for _ in range(2):
            live.capture(spark, str(folder), log, str(tmp_path / "at"), until_empty=True).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == 5
    rows = live.latest(got).orderBy("message_id").collect()
    assert [(r["message_id"], r["words"], r["status"], r["edits"]) for r in rows] == [(1, "sold", "ready", 1), (2, None, "needs_review", 1)]


def test_live_updates_reach_the_store(spark, tmp_path):
    message = lambda n, day, **more: {"message_id": n, "chat": {"id": 1}, "date": 1756684800 + day * 86400, **more}  # noqa: E731  September 2025
    deleted = lambda *ids: {"deleted_business_messages": {"chat": {"id": 1}, "message_ids": ids}}
    batches = [
        [{"update_id": 1, "message": message(1, 0, text="sofa")}, {"update_id": 2, "message": message(2, 1)}, {"update_id": 3, **deleted(4, 9)}, {"update_id": 4, "message": message(3, 40, text="bike")}],
        [{"update_id": 5, "edited_message": message(1, 0, edit_date=1756900000, text="sofa, sold")}, {"update_id": 6, "message": message(4, 2, text="gone")}, {"update_id": 8, "edited_message": message(5, 3, edit_date=1756990000, text="late edit")}],
        [{"update_id": 9, "edited_message": message(1, 0, edit_date=1756800000, text="an older edit")}, {"update_id": 10, **deleted(3)}, {"update_id": 7, "message": message(5, 3, text="before its edit")}, {"update_id": 11, "edited_message": message(2, 1, edit_date=1756900000, caption="a caption")}],
    ]
    kind = f"{live.UPDATE}, {live.DELETION}"
    read = lambda rows: live.changes(spark.createDataFrame([(json.dumps(x),) for x in rows], "j string").select(F.from_json("j", kind).alias("x")).select("x.*"))
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        live.follow(spark, str(folder), store, "u", str(tmp_path / "at"), until_empty=True).awaitTermination()
        if k == 0:  # what a classifier says of a text goes when the text changes
            some = store.read("entries", "2025-09").withColumns({"short_title": F.lit("old"), "manual_title": F.lit("mine")})
            store.commit(store.version(), {("entries", "2025-09"): some})
    assert store.mark("live") == 2
    version = store.version()
    assert not live.upsert(store, read(batches[0]), "u", "live", 2) and store.version() == version  # a batch that is run again

    def content(s):
        m = {r["id"]: r for r in s.read("messages").collect()}
        assert sorted(m) == list(range(1, len(m) + 1))
        return {(m[r["message_pk"]]["message_id"], m[r["message_pk"]]["source_text"], r["period_key"], r["excluded_reason"]) for r in s.read("entries").collect()}

    assert content(store) == {(1, "sofa, sold", "2025-09", None), (2, "a caption", "2025-09", None), (3, "bike", "2025-10", "deleted"), (4, "gone", "2025-09", "deleted"), (5, "late edit", "2025-09", None)}
    titles = {r["message_pk"]: (r["short_title"], r["manual_title"]) for r in store.read("entries", "2025-09").collect()}
    assert titles[1] == (None, "mine") and [r["message_id"] for r in store.read("states", "").collect()] == [9]
    again = Store(spark, str(tmp_path / "again"))
    assert live.upsert(again, read([x for rows in batches[::-1] for x in rows]), "u") and content(again) == content(store)
    live.upsert(again, read(batches[0]), "u")  # and some of it once more
    assert content(again) == content(store) and again.read("states").count() == store.read("states").count()


def test_packing_by_pointer_doubling(spark):
    rng, rows = random.Random(4), []
    for k in range(6):
        sizes = [[5] * 40, [20, 1, 19, 21, 22, 23, 1, 1], [rng.randint(1, 30) for _ in range(200)], [50] * 9, [1], [rng.choice([1, 2, 19, 20]) for _ in range(300)]][k]
        rows += [(f"p{k}", 3 * n, chr(97 + n % 26) * size) for n, size in enumerate(sizes)]
    blocks = spark.createDataFrame(rows, "period_key string, ord int, block string").repartition(3)
    listed = lambda df: sorted(map(tuple, df.collect()))
    for limit in (20, 22, 64):
        assert listed(R.doubled(blocks, limit)) == listed(R.folded(blocks, limit))
    assert R.doubled(blocks.where("false"), 20).count() == 0


def test_edition(spark):
    assert [one(spark, E.shortened(F.lit(x), 5)) for x in ("ab cd", "ab cde", "abcdef", "abcde f")] == ["ab cd", "ab", "abcde", "abcde"]
    assert one(spark, E.worded(F.lit(" \u3000"), F.lit("a\u00a0 b"))) == "a b"
    rows = spark.createDataFrame([("c", x) for x in (1, 2, 2, 5, 9, None)], "chat_id string, message_id long")
    for width in (1, 3, 100):
        assert sorted(tuple(r) for r in E.gaps(rows, width).collect()) == [("c", 3, 4), ("c", 6, 8)]
    twice = spark.createDataFrame([(None, "a"), (None, "a"), ("x", "a")], "k string, t string")
    assert sorted(r["duplicate"] for r in E.duplicate_titles(twice, ["k", "t"]).collect()) == [False, True, True]
    assert E.albums(spark.createDataFrame([], "chat_id long, message_id long, media_group_id string, source_text string")).count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.project(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, rows))

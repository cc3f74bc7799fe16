"""The four commands as functions: import, classify, render, and delivery through an injected sender."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions.period import canonical
from ..operators import classify as C
from ..operators import render as R
from ..operators import layout
from ..operators import edition as E
from ..operators.edition import by_rule, split_blocks, text_hash, unsent
from ..operators.lineage import cut
from ..operators.merging import merged
from ..operators.moderation import FIELDS, acted
from ..operators.store import Conflict, Store, absent, first_by, numbered
from ..sources import export
from ..streaming import live

#: The keys of the reply are fixed values, as the reply's reader expects them.
INSTRUCTIONS = """Ниже строки с объявлениями участников группы{place} за месяц; подготовь их для обзора.
Решай по каждой строке отдельно: объявление включай, а реплики, споры и служебные записи отмечай include=false.
Заголовок короткий, не длиннее 34 знаков; в нём нет сумм, телефонов, имён пользователей, адресов сайтов и слов из названия рубрики.
В заголовок бери самое важное: что это, для кого, в чём отличие. Если речь о другом населённом пункте{other}, назови его.
Внутри одной рубрики заголовки не должны повторяться.
Рубрик бери мало, каждая должна подходить нескольким объявлениям.
Ответ состоит из одного объекта JSON такого вида:
{{"categories":[{{"code":"...","title":"...","emoji":"..."}}],"entries":[{{"id":1,"include":true,"category":"...","title":"...","confidence":"high|low"}}]}}
Строки:
"""


def prompt(rows: list[dict], place: str = "") -> str:
    return INSTRUCTIONS.format(place=place and f" {place}", other=place and f", не {place}") + C.payload(rows)


def import_export(spark: SparkSession, store: Store, path: str, period: str, chat_id: str, username: str) -> int:
    """Add an export's messages of a month; the number of those that qualify, known ones included."""
    period = canonical(period)
    rows = export.qualifying(export.scan(spark, path), period, chat_id, username).cache()
    n = rows.count()
    if n and not username:
        raise ValueError("a source username is needed for links")
    if n:
        add(store, period, first_by(rows, ["chat_id", "message_id"], "pos"), "pos")
    rows.unpersist()
    return n


def import_by_rules(spark: SparkSession, store: Store, path: str, period: str, chat_id: str, username: str, zone: str = "Europe/Madrid") -> int:
    """As :func:`import_export`, with the documents' rules; the number of the month's messages, known ones included. The month is
    that of the zone. Messages without text wait for a review, an album has one entry, and texts are in Unicode's composed form.
    A message that was edited since it was stored, or that the live stream has in another version, has its latest text; it is
    then classified anew. Every call makes a version."""
    period, key = canonical(period), ["chat_id", "message_id"]
    rows = export.told(export.scan(spark, path), period, chat_id, zone).cache()
    n = rows.select(*key).distinct().count()
    if n and not username:
        raise ValueError("a source username is needed for links")
    if n:
        facts = first_by(rows, key, "pos").select(*key, "sender_name", "media_type")
        live.upsert(store, rows.drop("pos", "sender_name", "media_type"), username, facts=facts)
    rows.unpersist()
    return n


def warnings(store: Store, period: str) -> DataFrame:
    """What someone should look at before the period's edition goes out: kind, chat_id, first_id, last_id, title."""
    period, base = canonical(period), store.version()
    return E.warnings(standing(store, period, base), store.read("messages", period, base))


def add(store: Store, period: str, rows: DataFrame, order: str) -> int:
    """Add messages that the store has not, with their entries, to a period; how many. Nothing to add makes no version."""
    base = store.version()
    # known in any period: a pruned scan of the keys
    fresh = absent(rows, store.read("messages", version=base), ["chat_id", "message_id"]).cache()
    n = fresh.count()
    if n:
        columns = [x.split()[0] for x in schema.MESSAGES.split(", ")]
        new = numbered(fresh, store.top(base), order).withColumn("imported_at", F.current_timestamp()).select(columns)
        given = {"message_pk": F.col("id"), "period_key": F.lit(period), "eligible": F.lit(1)}
        kinds = [x.split() for x in schema.ENTRIES.split(", ")]
        entries = new.select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds])
        store.commit(base, {("messages", period): store.read("messages", period, base).union(new), ("entries", period): store.read("entries", period, base).union(entries)})
    fresh.unpersist()
    return n


def classify(spark: SparkSession, store: Store, period: str, providers: dict[str, Callable[[str], str]], place: str = "") -> str:
    """Classify a period's entries; the provider's name. A rejected reply changes nothing."""
    period, base = canonical(period), store.version()
    known = store.read("entries", period, base)
    asked = C.requests(store.read("messages", period, base), standing(store, period, base), period).cache()
    rows = [r.asDict() for r in asked.collect()]  # one request holds them all
    if not rows:
        return "nothing to classify"
    name, new = C.cascade(spark, asked, providers, prompt(rows, place))
    store.commit(base, {("entries", period): C.updated(known, new, period, name)})
    return name


def classify_by_rules(spark: SparkSession, store: Store, period: str, providers: dict[str, Callable[[str], str]], place: str = "") -> str:
    """As :func:`classify`, with the documents' rules: a text that the month has a result for, by its hash, is not asked for again; where
    no provider gives a valid reply, entries get titles by rule, which are not kept as results, and the rest goes on; small
    categories are merged into the nearest. An album is asked for by its text, and excluded entries are not asked for. The provider's name, ``cache`` if nothing was asked, or ``rules``."""
    period, base = canonical(period), store.version()
    known, results, stand = store.read("entries", period, base), store.read("results", period, base), standing(store, period, base)
    messages = E.spoken(store.read("messages", period, base), stand)
    texts = messages.select("id", "source_text", text_hash(F.col("source_text")).alias("text_hash"))
    asked = C.requests(messages, stand.where("excluded_reason is null"), period).join(texts.select("id", "text_hash"), "id").cache()
    if asked.isEmpty():
        return "nothing to classify"
    fresh = asked.join(results.select("text_hash"), "text_hash", "left_anti").select("id", "text", "text_hash")
    columns = [x.split()[0] for x in schema.RESULTS.split(", ")][2:]
    name, found = "cache", results.select("text_hash", *columns)
    # one request for each text; it holds them all
    one = cut(fresh.groupBy("text_hash").agg(F.min_by(F.struct("id", "text"), "id").alias("x")).select("x.*", "text_hash"))
    rows = [r.asDict() for r in one.select("id", "text").orderBy("id").collect()]
    if rows:
        try:
            name, new = C.cascade(spark, one, providers, prompt(rows, place))
            new = new.join(one.select("id", "text_hash"), "id")
        except RuntimeError:
            name, ruled = "rules", by_rule(one.select("id", "text_hash").join(texts.select("id", "source_text"), "id"))
            emoji = {"category_title": F.lit(T.NO_CATEGORY), "category_emoji": F.lit(T.NO_EMOJI), "confidence": F.lit("low")}
            new = ruled.withColumns({**emoji, "eligible": F.col("title").isNotNull().cast("int")})
        new = cut(new.withColumn("provider", F.lit(name)).select("text_hash", *columns))
        found = found.union(new)
    of_entries = cut(asked.select("id", "text_hash").join(found, "text_hash"))
    # only shown entries make a category large; its title and emoji come with the category that it is merged into
    shown = of_entries.where("eligible = 1")
    moved = merged(shown.select(F.lit(period).alias("period_key"), "category", "title")).where("merged != category").select("category", F.col("merged").alias("to"))
    looks = shown.groupBy(F.col("category").alias("to")).agg(F.min(F.struct("category_title", "category_emoji")).alias("look"))
    final = of_entries.join(moved.join(looks, "to"), "category", "left")
    final = final.withColumns({"category_title": F.when(F.col("to").isNull(), F.col("category_title")).otherwise(F.col("look.category_title")), "category_emoji": F.when(F.col("to").isNull(), F.col("category_emoji")).otherwise(F.col("look.category_emoji")), "category": F.coalesce("to", "category")})
    changes = {("entries", period): C.updated(known, final, period, name)}
    if rows and name != "rules":
        changes["results", period] = results.union(new.select(F.lit(period).alias("period_key"), "text_hash", *columns))
    store.commit(base, changes)
    asked.unpersist()
    return name


def standing(store: Store, period: str, version: int) -> DataFrame:
    """A period's entries with what was set by hand, as of a version."""
    entries = store.read("entries", period, version)
    if not any((r["table_name"], r["period_key"]) == ("actions", period) for r in store.manifest(version)):
        return entries
    return acted(entries, store.read("actions", period, version))


def act(store: Store, period: str, actor: str, kind: str, message_pk: int | None = None, field: str | None = None, value: str | None = None, target: int | None = None) -> int:
    """Add an action to a period's log: ``set`` a field of an entry, ``undo`` or ``redo`` an earlier set; the action's number,
    which is the version that it makes. Two writers at once: one gets a Conflict and nothing of its is kept."""
    period, base = canonical(period), store.version()
    known = store.read("actions", period, base)
    if kind == "set":
        found = field in FIELDS and not store.read("entries", period, base).where(F.col("message_pk") == message_pk).isEmpty()
    else:
        found = kind in ("undo", "redo") and not known.where((F.col("kind") == "set") & (F.col("action_id") == target)).isEmpty()
    if not found:
        raise ValueError(f"no such entry, field or action in {period}")
    row = (base + 1, datetime.now(UTC), actor, kind, period, message_pk, field, value, target)
    return store.commit(base, {("actions", period): known.union(store.spark.createDataFrame([row], schema.ACTIONS))})


def rendered(store: Store, period: str, brand: str, version: int, paged: str = "") -> DataFrame:
    """period_key, part_no, total, html of a period as of a version. ``paged``: a link to the group; blocks over the limit are
    then split, and headers and footers, which have the link, count against it."""
    if paged:
        lines = R.lines(standing(store, period, version), store.read("messages", period, version))
        room = T.LIMIT - layout.OVERHEAD
        blocks = split_blocks(lines, room).select("period_key", F.struct("ord", "piece").alias("ord"), "block")
        return layout.paged(blocks, T.LIMIT, brand, paged)
    most = sum(r["rows"] for r in store.manifest(version) if (r["table_name"], r["period_key"]) == ("entries", period))
    return R.digest(standing(store, period, version), store.read("messages", period, version), T.LIMIT, brand, most)


def render(store: Store, period: str, brand: str = "обЪявления", paged: str = "") -> list[str]:
    """The parts of a period, in order."""
    return [r["html"] for r in rendered(store, canonical(period), brand, store.version(), paged).orderBy("part_no").collect()]


def pinned(store: Store, period: str, destination: str, brand: str = "обЪявления", paged: str = "") -> list[Row]:
    """The parts of the period's edition for a destination, in order. The first call renders the store as it is and pins the
    edition: its parts, the version that they were read from, and a hash of all of them. Later calls return the same
    parts, whatever has been imported or classified since. Of two first calls at once one pins, the other gets its edition."""
    period = canonical(period)
    while True:
        base = store.version()
        known = store.read("editions", period, base)
        mine = known.where(F.col("destination") == destination).orderBy("part_no").collect()  # parts of one edition
        if mine:
            texts = [r["html"] for r in mine]
            if len(mine) != mine[0]["total"] or any(r["edition"] != edition_hash(texts) for r in mine):
                raise ValueError(f"the pinned edition of {period} is damaged")
            return mine
        parts = rendered(store, period, brand, base, paged).orderBy("part_no").collect()
        if not parts:
            return []
        mark = edition_hash([r["html"] for r in parts])
        new = store.spark.createDataFrame([(period, destination, mark, base, r["part_no"], r["total"], r["html"]) for r in parts], schema.EDITIONS)
        try:
            store.commit(base, {("editions", period): known.union(new)})
        except Conflict:
            continue


def edition_hash(parts: list[str]) -> str:
    """Of the parts' texts and where each ends."""
    found = hashlib.sha256()
    for x in parts:
        data = x.encode()
        found.update(len(data).to_bytes(8, "big") + data)
    return found.hexdigest()


def publish(parts: list[str], send: Callable[[str, str, str], object], token: str, target: str) -> None:
    if not token or not target:
        raise SystemExit("a bot token and a target chat are needed")
    for part in parts:
        send(token, target, part)


def publish_rest(store: Store, period: str, send: Callable[[str, str, str], dict], token: str, target: str, brand: str = "обЪявления", paged: str = "") -> int:
    """Send the parts of the pinned edition that the target has not got, in order, and log each with its message's id; how
    many were sent. After a failure the next run goes on with the part that failed, of the same edition. A logged part that
    is not the edition's is an error, and so is a reply without an id."""
    if not token or not target:
        raise SystemExit("a bot token and a target chat are needed")
    period = canonical(period)
    parts = pinned(store, period, target, brand, paged)
    if not parts:
        return 0
    listed = store.spark.createDataFrame([(r["period_key"], r["part_no"], r["html"]) for r in parts], "period_key string, part_no int, html string")
    log = store.read("publications", period)
    ours = log.where((F.col("destination") == target) & F.col("telegram_message_id").isNotNull())
    if not ours.join(listed, "part_no", "left").where("html is null or html != rendered_html").isEmpty():
        raise ValueError(f"parts of another edition of {period} were sent to this target")
    rest = unsent(listed, log, target).orderBy("part_no").collect()  # parts of one edition
    for r in rest:
        reply = send(token, target, r["html"])
        store.sent(r["period_key"], target, r["part_no"], int(reply["result"]["message_id"]), r["html"])
    return len(rest)


def root() -> Path:
    return Path(__file__).resolve().parents[2]

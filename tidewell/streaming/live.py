"""Live capture: files of updates, a JSON object a line, become an append-only log, or the store's messages.

The log keeps every update, late ones too; a file is taken once, as the stream's checkpoint tells. An update that arrives
in two files is in the log twice, and :func:`latest` reduces to one row a message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import edition as E
from ..operators.lineage import cut
from ..operators.store import Conflict, Store, absent, numbered

_MESSAGE = "struct<message_id: long, chat: struct<id: long>, date: long, edit_date: long, text: string, caption: string, media_group_id: string>"
#: Names of the members are fixed values.
UPDATE = f"update_id long, message {_MESSAGE}, edited_message {_MESSAGE}"
DELETION = "deleted_business_messages struct<chat: struct<id: long>, message_ids: array<long>>"
DELETED = E.DELETED


def captured(updates: DataFrame) -> DataFrame:
    """A row for each update that holds a message or an edit, with its words, or a status that asks for review."""
    rows = updates.select("update_id", F.coalesce("message", "edited_message").alias("m"), F.col("message").isNull().alias("edited")).where("m.message_id is not null and m.chat.id is not null")
    at = F.coalesce("m.edit_date", "m.date")
    found = rows.select("update_id", F.col("m.chat.id").alias("chat_id"), F.col("m.message_id").alias("message_id"), F.timestamp_seconds(at).alias("at"), "edited", F.col("m.media_group_id").alias("media_group_id"), E.worded(F.col("m.text"), F.col("m.caption")).alias("words"))
    return found.withColumn("status", E.status(F.col("words")))


def capture(spark: SparkSession, folder: str, log: str, checkpoint: str, until_empty: bool = False) -> StreamingQuery:
    """Follow a folder into the log; ``until_empty`` ends when the files that are there are done."""
    stream = captured(spark.readStream.schema(UPDATE).json(folder)).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if until_empty else stream).start()


def latest(log: DataFrame) -> DataFrame:
    """The last version of each message; of versions at one instant that with the highest update id. ``edits`` counts updates
    that are edits, each once."""
    rest = [c for c in log.columns if c not in ("chat_id", "message_id", "edited")]
    once = log.dropDuplicates(["update_id"])
    last = F.max_by(F.struct(*rest), F.struct("at", "update_id")).alias("x")
    return once.groupBy("chat_id", "message_id").agg(last, F.count_if("edited").alias("edits")).select("chat_id", "message_id", "x.*", "edits")


def changes(updates: DataFrame, zone: str = "UTC") -> DataFrame:
    """What each update says of a message, in the columns of the store's states: a text and when it was written, or that the
    message is deleted. ``updates`` has the columns of UPDATE and DELETION. Months are those of the zone (in a session whose own
    zone is UTC)."""
    said = captured(updates).join(updates.select("update_id", F.coalesce("message.date", "edited_message.date").alias("sent")).dropDuplicates(["update_id"]), "update_id")
    sent = F.timestamp_seconds("sent")
    texts = said.select(F.date_format(F.from_utc_timestamp(sent, zone), "yyyy-MM").alias("period_key"), F.col("chat_id").cast("string").alias("chat_id"), "message_id", sent.alias("sent_at"), "at", "update_id", "words", "media_group_id", F.lit(False).alias("deleted"))
    gone = updates.select("update_id", F.col("deleted_business_messages.chat.id").cast("string").alias("chat_id"), F.explode("deleted_business_messages.message_ids").alias("message_id"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("sent_at", "timestamp"), ("at", "timestamp"))]
    gone = gone.select(F.lit("").alias("period_key"), "chat_id", "message_id", *none, F.lit(None).cast("long").alias("update_id"), *[F.lit(None).cast("string").alias(c) for c in ("words", "media_group_id")], F.lit(True).alias("deleted"))
    return texts.union(gone.where("chat_id is not null and message_id is not null"))


def states(rows: DataFrame) -> DataFrame:
    """One state a message: the last text by time and update id, and whether it was ever deleted. The same whatever the order
    of the rows, and however often a row or a state made of some of them comes again."""
    last = F.max_by(F.struct("sent_at", "at", "update_id", "words", "media_group_id"), F.when(F.col("update_id").isNotNull(), F.struct("at", "update_id")))
    found = rows.groupBy("chat_id", "message_id").agg(F.max("period_key").alias("period_key"), last.alias("x"), F.bool_or("deleted").alias("deleted"))
    return found.select("period_key", "chat_id", "message_id", "x.*", "deleted")


def _applied(store: Store, version: int, period: str, now: DataFrame, username: str, after: int, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A period's messages and entries after the states ``now`` of some of its messages: new ones are added, a changed text
    (of the message or its album) clears what a classifier said of the old one, and what is deleted, has no text or is not the
    first of its album is not shown. ``facts``: sender_name and media_type of new messages, by chat_id and message_id."""
    key = ["chat_id", "message_id"]
    messages, entries = store.read("messages", period, version), store.read("entries", period, version)
    said = now.select(*key, F.coalesce("words", F.lit("")).alias("__words"), F.when(F.col("deleted"), DELETED).when(F.col("words").isNull(), E.REVIEW).alias("__why"), F.lit(True).alias("__told"))
    met = messages.join(said, key, "left").withColumn("__changed", F.col("__told") & (F.col("__words") != E.prepared(F.col("source_text"))))
    text = F.when(F.col("__changed"), F.col("__words")).otherwise(F.col("source_text"))
    kept = met.select(*[text.alias(c) if c == "source_text" else F.col(c) for c in messages.columns])
    fresh = numbered(absent(now, messages, key), after, "update_id")
    if facts is not None:
        fresh = fresh.join(facts, key, "left")
    fact = lambda name, default: F.col(name) if facts is not None else F.lit(default).cast("string")
    columns = {"published_at": F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss"), "source_text": F.coalesce("words", F.lit("")), "source_url": T.source_url(username, F.col("message_id")), "imported_at": F.current_timestamp(), "sender_name": fact("sender_name", ""), "media_type": fact("media_type", None)}
    added = fresh.select(*[columns.get(c, F.col(c)).alias(c) for c in messages.columns])
    why = met.where("__told").select(F.col("id").alias("message_pk"), "__why", "__changed")
    was = F.col("excluded_reason")
    free = was.isNull() | was.isin(E.REVIEW, E.ALBUM)
    reason = F.when(F.col("__changed").isNotNull() & free, F.col("__why")).otherwise(was)
    clear = lambda told: {c: F.when(~F.coalesce(told, F.lit(False)), F.col(c)) for c in ("category_code", "category_title", "category_emoji", "short_title", "confidence", "provider")}
    now_ = {"excluded_reason": reason} | clear(F.col("__changed"))
    old = entries.join(why, "message_pk", "left").select(*[now_.get(c, F.col(c)).alias(c) for c in entries.columns])
    given = {"message_pk": F.col("id"), "period_key": F.lit(period), "eligible": F.lit(1), "excluded_reason": F.when(F.col("deleted"), DELETED).when(F.col("words").isNull(), E.REVIEW)}
    new = fresh.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema])
    albums = now.where("media_group_id is not null").select("chat_id", "media_group_id").distinct()
    if albums.isEmpty():
        return kept.union(added), old.union(new)
    messages_now, entries_now = cut(kept.union(added)), cut(old.union(new))
    # albums of other messages stay as they are
    some = cut(messages_now.join(albums, ["chat_id", "media_group_id"], "left_semi").select(*messages.columns))
    entries_now = E.by_album(some, entries_now)
    before = E.of_albums(messages.join(albums, ["chat_id", "media_group_id"], "left_semi"), entries).where("first").select("message_pk", F.col("words").alias("__was"))
    other = E.of_albums(some, entries_now).where("first").join(before, "message_pk", "left").where(~F.col("words").eqNullSafe(F.col("__was"))).select("message_pk", F.lit(True).alias("__other"))
    cleared = clear(F.col("__other"))
    return messages_now, entries_now.join(other, "message_pk", "left").select(*[cleared.get(c, F.col(c)).alias(c) for c in entries.columns])


def upsert(store: Store, said: DataFrame, username: str, stream: str = "live", batch: int | None = None, facts: DataFrame | None = None) -> bool:
    """Bring changes into the store as one version; False if the store has the stream's batch already.

    States of the messages that the changes name are merged with those that the store keeps, in whatever period, and only
    the periods of these messages are written. Deletions of messages not seen yet wait in a period without a name."""
    key = ["chat_id", "message_id"]
    while True:
        base = store.version()
        if batch is not None and store.mark(stream, base) >= batch:
            return False
        new = states(said).cache()
        held = store.read("states", version=base).join(new.select(*key), key, "left_semi").select(*new.columns).cache()
        now = states(held.union(new)).cache()
        periods = sorted({r["period_key"] for r in held.select("period_key").union(now.select("period_key")).distinct().collect()})  # months that a batch names
        out, after = {}, store.top(base)
        for p in periods:
            kept = absent(store.read("states", p, base), now, key).select(*now.columns)
            out["states", p] = kept.union(now.where(F.col("period_key") == p))
            if p:
                mine = now.where(F.col("period_key") == p)
                out["messages", p], out["entries", p] = _applied(store, base, p, mine, username, after, facts)
                after += absent(mine, store.read("messages", p, base), key).count()
        try:
            store.commit(base, out, {stream: batch} if batch is not None else None)
            return True
        except Conflict:
            continue
        finally:
            for df in (new, held, now):
                df.unpersist()


def follow(spark: SparkSession, folder: str, store: Store, username: str, checkpoint: str, stream: str = "live", until_empty: bool = False, zone: str = "UTC") -> StreamingQuery:
    """Follow a folder of updates into the store. A batch and its number are one version, so a batch that is run again after a
    failure changes nothing."""
    rows = spark.readStream.schema(f"{UPDATE}, {DELETION}").json(folder)
    out = rows.writeStream.foreachBatch(lambda df, n: upsert(store, changes(df, zone), username, stream, n) and None).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if until_empty else out).start()

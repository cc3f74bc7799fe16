"""Rules of an edition that the documents ask for beyond import, classification and rendering.

Texts are compared as prepared: white space collapsed and stripped. Nulls: a null text has no hash and is never cached; a
null title or category equals another null when duplicates are looked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Lengths of a title with the arrow that follows it, or alone (fixed values).
TARGET, PREFERRED, HARD = 30, 34, 42
REVIEW, OTHER = "needs_review", "other"
#: Why an entry is not shown, beside REVIEW: another entry stands for its album, or its message was deleted.
ALBUM, DELETED = "album", "deleted"
MORE = " — продолжение"


def prepared(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{T.SPACE}]+", " "))


def normalised(text: Column | str) -> Column:
    """In Unicode's composed form (NFC). Spark has no function for it, but brings ICU, whose static method is called for one
    row after another; no batch of texts goes to Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)))


def text_hash(text: Column) -> Column:
    return F.sha2(prepared(text), 256)


def worded(text: Column, caption: Column) -> Column:
    """The text, else the caption, prepared; null where neither has a word."""
    return F.coalesce(F.nullif(prepared(text), F.lit("")), F.nullif(prepared(caption), F.lit("")))


def status(words: Column) -> Column:
    return F.when(words.isNull(), REVIEW).otherwise("ready")


def edited(stored: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the text of their latest edit, and ``changed`` where its hash is another. Edits at one instant: the
    greatest text counts. Edits of rows that are not stored are ignored."""
    last = edits.groupBy(*keys).agg(F.max(F.struct("edited_at", "source_text")).alias("__last"))
    rows = stored.join(last, keys, "left")
    text = F.when(F.col("__last").isNotNull(), F.col("__last.source_text")).otherwise(F.col("source_text"))
    return rows.withColumns({"source_text": text, "changed": ~text_hash(text).eqNullSafe(text_hash(F.col("source_text")))}).drop("__last")


def albums(rows: DataFrame) -> DataFrame:
    """One row for each album or single message: its first id, its number of messages, and the first text that it has."""
    own = F.struct(F.col("media_group_id"), F.when(F.col("media_group_id").isNull(), F.col("message_id")).alias("single"))
    words = F.nullif(prepared(F.col("source_text")), F.lit(""))
    first = F.min(F.when(words.isNotNull(), F.struct(F.col("message_id"), words.alias("words"))))
    found = rows.groupBy("chat_id", own.alias("__own")).agg(F.min("message_id").alias("first_id"), F.count("*").alias("messages"), first["words"].alias("words"))
    return found.select("chat_id", F.col("first_id").alias("message_id"), "messages", "words", status(F.col("words")).alias("status"))


def of_albums(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Of each message of an album that is not deleted: message_pk, whether it is the album's ``first`` one by message id, and
    ``words``, the first text that the album has. Only messages with a ``media_group_id`` are shuffled."""
    key = ["chat_id", "media_group_id"]
    words = F.nullif(prepared(F.col("source_text")), F.lit(""))
    alive = entries.where(~F.col("excluded_reason").eqNullSafe(DELETED)).select("message_pk")
    rows = messages.where("media_group_id is not null").select(F.col("id").alias("message_pk"), "message_id", *key, words.alias("words")).join(alive, "message_pk")
    text = F.min(F.when(F.col("words").isNotNull(), F.struct("message_id", "words")))
    whole = rows.groupBy(*key).agg(F.min("message_id").alias("first_id"), text["words"].alias("words"))
    return rows.drop("words").join(whole, key).select("message_pk", (F.col("message_id") == F.col("first_id")).alias("first"), "words")


def by_album(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of which one stands for an album: that of its first message that is not deleted, shown if the album has a text.
    The others are not shown. Entries that are excluded for a reason of their own stay as they are."""
    found = of_albums(messages, entries).select("message_pk", F.when(~F.col("first"), ALBUM).when(F.col("words").isNull(), REVIEW).alias("__why"), F.lit(True).alias("__album"))
    free = F.col("excluded_reason").isNull() | F.col("excluded_reason").isin(ALBUM, REVIEW)
    reason = F.when(F.col("__album") & free, F.col("__why")).otherwise(F.col("excluded_reason"))
    return entries.join(found, "message_pk", "left").select(*[reason.alias(c) if c == "excluded_reason" else F.col(c) for c in entries.columns])


def spoken(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Messages, the first of each album with the album's text."""
    first = of_albums(messages, entries).where("first and words is not null").select(F.col("message_pk").alias("id"), F.col("words").alias("__words"))
    text = F.coalesce("__words", "source_text")
    return messages.join(first, "id", "left").select(*[text.alias(c) if c == "source_text" else F.col(c) for c in messages.columns])


def uncached(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows whose text no result is kept for; ``results`` has a ``text_hash``."""
    return rows.withColumn("text_hash", text_hash(F.col("source_text"))).join(results.select("text_hash"), "text_hash", "left_anti")


def shortened(text: Column, limit: int = PREFERRED) -> Column:
    """The words that fit the limit; a first word over it is cut."""
    head = F.substring(text, 1, limit + 1)
    words = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).when(words != head, words).otherwise(F.substring(text, 1, limit))


def by_rule(rows: DataFrame) -> DataFrame:
    """What rows get when no provider answers: category ``other`` and a shortened title, or a review where there is no text."""
    words = F.col("__words")
    found = rows.withColumn("__words", F.nullif(prepared(F.col("source_text")), F.lit("")))
    return found.withColumns({"category": F.when(words.isNotNull(), OTHER), "title": shortened(words), "status": status(words)}).drop("__words")


def title_grade(title: Column) -> Column:
    n = F.length(title)
    return F.when(n + 2 <= TARGET, "target").when(n <= PREFERRED, "preferred").when(n <= HARD, "allowed").when(n > HARD, "too long")


def duplicate_titles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``duplicate``: another row has the same keys. Keys are counted before they meet the rows again."""
    counts = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.count("*").alias("__n")).where("__n > 1")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(counts, same, "left").withColumn("duplicate", F.col("__n").isNotNull()).drop("__n", *[f"__{c}" for c in keys])


def gaps(rows: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Runs of message ids that are missing between others of a chat: chat_id, first_missing, last_missing.

    A chat may hold most rows, so ids are compared within cells of ``width`` ids, and then cells by their ends alone."""
    ids = rows.select("chat_id", F.col("message_id").cast("long").alias("id")).where("id is not null").distinct()
    celled = ids.withColumn("cell", F.expr(f"id div {width}"))
    inside = celled.select("chat_id", "id", F.lag("id").over(Window.partitionBy("chat_id", "cell").orderBy("id")).alias("before"))
    ends = celled.groupBy("chat_id", "cell").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    between = ends.select("chat_id", "id", F.lag("last").over(Window.partitionBy("chat_id").orderBy("cell")).alias("before"))
    return inside.unionByName(between).where("id - before > 1").select("chat_id", (F.col("before") + 1).alias("first_missing"), (F.col("id") - 1).alias("last_missing"))


def warnings(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """What someone should look at before an edition goes out: kind, chat_id, first_id, last_id, title.

    Of entries: ``needs_review`` (no text), and of shown ones ``no title``, ``long title`` (over the hard limit) and
    ``same title`` (another shown entry of the month has the same title in the same category). Of messages: ``gap``, a run of
    ids that are missing between others of a chat. Titles and categories set by hand count, empty ones do not.
    """
    title = F.nullif(T.first_filled(F.col("manual_title"), F.col("short_title"), F.lit("")), F.lit(""))
    category = T.first_filled(F.col("manual_category"), F.col("category_title"), F.lit(T.NO_CATEGORY))
    shown = (F.col("eligible") == 1) & F.col("excluded_reason").isNull()
    rows = entries.select("message_pk", "period_key", F.col("excluded_reason").eqNullSafe(REVIEW).alias("review"), F.coalesce(shown, F.lit(False)).alias("shown"), title.alias("title"), category.alias("category")).where("review or shown")
    same = duplicate_titles(rows.where("shown and title is not null"), ["period_key", "category", "title"]).where("duplicate").select("message_pk", F.lit("same title").alias("kind"), "title")
    kinds = F.array(F.when(F.col("review"), REVIEW), F.when(F.col("shown") & F.col("title").isNull(), "no title"), F.when(F.col("shown") & (title_grade(F.col("title")) == "too long"), "long title"))
    found = rows.select("message_pk", F.explode(F.array_compact(kinds)).alias("kind"), "title").union(same)
    at = messages.select(F.col("id").alias("message_pk"), "chat_id", "message_id")
    told = found.join(at, "message_pk").select("kind", "chat_id", F.col("message_id").alias("first_id"), F.col("message_id").alias("last_id"), "title")
    return told.union(gaps(messages).select(F.lit("gap").alias("kind"), "chat_id", "first_missing", "last_missing", F.lit(None).cast("string").alias("title")))


def unsent(parts: DataFrame, publications: DataFrame, destination: str) -> DataFrame:
    """Parts that have no message id at the destination yet."""
    sent = publications.where((F.col("destination") == destination) & F.col("telegram_message_id").isNotNull())
    return parts.join(sent.select("period_key", "part_no").distinct(), ["period_key", "part_no"], "left_anti")


def split_blocks(rows: DataFrame, limit: int = T.LIMIT) -> DataFrame:
    """Blocks as in rendering, but one over the limit goes on in further blocks whose headers say so. A line is never cut:
    one that is over the limit by itself has a block of its own."""
    key = ["period_key", "emoji", "category"]
    head = lambda more: F.concat(F.col("emoji"), F.lit(" <b>"), T.escape(F.col("category")), F.lit(f"{more}</b>\n"))
    given = [*key, "rank", "line"]

    def pieces(group: pa.Table) -> pa.Table:  # one pass over lengths; a fold in Spark copies its array at every line
        group = group.sort_by([("rank", "ascending"), ("line", "ascending")])
        room, used, found, joins = group.column("room")[0].as_py(), 0, [], []
        for size in group.column("size").to_pylist():
            fits = bool(found) and (used == 0 or used + size + 1 <= room)
            joins.append(fits and used > 0)
            found.append(found[-1] + (not fits) if found else 0)
            used = used + joins[-1] + size if fits else size
        ord_ = pa.array([group.column("rank")[0].as_py()] * len(found), group.schema.field("rank").type)
        return group.select(given).append_column("ord", ord_).append_column("piece", pa.array(found, pa.int32())).append_column("joins", pa.array(joins))

    sized = rows.select(*given, F.length("line").alias("size"), (F.lit(limit) - F.length(head(MORE))).alias("room"))
    rank = rows.schema["rank"].dataType.simpleString()
    kinds = f"period_key string, emoji string, category string, rank {rank}, line string, ord {rank}, piece int, joins boolean"
    each = sized.groupBy(*key).applyInArrow(pieces, kinds).groupBy(*key, "ord", "piece").agg(F.sort_array(F.collect_list(F.struct("rank", "line", "joins"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.concat(F.when(x["joins"], "\n").otherwise(""), x["line"])), "")
    return each.select("period_key", "ord", "piece", F.concat(F.when(F.col("piece") == 0, head("")).otherwise(head(MORE)), body).alias("block"))

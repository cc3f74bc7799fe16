"""What people decide about messages and entries, as logs: states of moderation, and edits of fields with undo.

Logs may hold an action twice and in any order; what counts is the instant or the number that an action carries.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .store import CELL_ROWS, cell_of

STATES = ("pending", "accepted", "rejected", "excluded", "deleted")
#: Where an event leads from each state; any other event is illegal there and changes nothing.
STEPS = {
    "accept": {"pending": "accepted", "rejected": "accepted"},
    "reject": {"pending": "rejected", "accepted": "rejected"},
    "exclude": {"accepted": "excluded"},
    "restore": {"excluded": "accepted"},
    "delete": {"pending": "deleted", "accepted": "deleted", "rejected": "deleted", "excluded": "deleted"},
}
#: A map of states to states is a text with a digit for each state; this one keeps them all.
SAME = "".join(str(i) for i in range(len(STATES)))
BLOCK = 512
LINK = r"^https://t\.me/[A-Za-z0-9_]+/[0-9]+$"

#: Fields that may be set by hand.
FIELDS = ("manual_title", "manual_category", "excluded_reason")


def _then(first: Column, second: Column) -> Column:
    return F.call_function("translate", first, F.lit(SAME), second)


def _scanned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key its rows' ``x`` in order, ``start`` with what the moves before each come to, and ``move`` with what all do."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    starts = F.aggregate("x", F.array(F.lit(SAME)), lambda acc, x: F.concat(acc, F.array(_then(F.element_at(acc, -1), x["move"]))))
    return listed.withColumn("start", starts).withColumn("move", F.element_at("start", -1))


def steps(events: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """message_id, seq, event, before, after, legal: the events of each message in the order of ``seq``, a number that counts
    for all messages, with the states before and after. Events of one number: by name. Events without a number are left
    out; a null message is one message; a null or unknown event is illegal.

    One message may have most events. So events are cut into cells by number, and a message's events of a cell into blocks.
    A block, a cell and a message each come to a map of states, and maps composed in order give the state that each
    block begins in. No row holds more than ``BLOCK`` events, a cell's blocks, or a message's cells.
    """
    rows = cut(events.where("seq is not null").select("message_id", "seq", "event").distinct())
    cell, _ = cell_of(rows, "seq", cell_rows)
    maps = {e: "".join(str(STATES.index(to.get(s, s))) for s in STATES) for e, to in STEPS.items()}
    move = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in maps.items() for x in pair]), F.col("event")), F.lit(SAME))
    celled = rows.withColumns({"cell": cell, "move": F.when(F.col("event").isNull(), SAME).otherwise(move)})
    place = F.row_number().over(Window.partitionBy("message_id", "cell").orderBy("seq", F.asc_nulls_first("event"))) - 1
    blocked = celled.withColumn("block", F.floor(place / BLOCK))
    blocks = cut(_scanned(blocked.select("message_id", "cell", "block", F.struct("seq", "event", "move").alias("x")), ["message_id", "cell", "block"]))
    cells = _scanned(blocks.select("message_id", "cell", F.struct("block", "move").alias("x")), ["message_id", "cell"])
    whole = _scanned(cells.select("message_id", F.struct("cell", "move").alias("x")), ["message_id"])

    zipped = lambda df, *keys: df.select(*keys, F.explode(F.arrays_zip("x", F.slice("start", F.lit(1), F.size("x")).alias("start"))).alias("z"))
    of_cells = zipped(whole, "message_id").select("message_id", F.col("z.x.cell").alias("cell"), F.col("z.start").alias("of_cell"))
    of_blocks = zipped(cells, "message_id", "cell").select("message_id", "cell", F.col("z.x.block").alias("block"), F.col("z.start").alias("of_block"))
    begun = _joined(_joined(blocks, of_blocks, ["message_id", "cell", "block"]), of_cells, ["message_id", "cell"])
    at = _then(_then(F.lit(SAME[0]), F.col("of_cell")), F.col("of_block"))
    each = zipped(begun.withColumn("at", at), "message_id", "at").select("message_id", "z.x.*", _then(F.col("at"), F.col("z.start")).alias("before"))
    each = each.withColumn("after", _then(F.col("before"), F.col("move")))
    name = lambda c: F.element_at(F.array(*map(F.lit, STATES)), F.col(c).cast("int") + 1).alias(c)
    return each.select("message_id", "seq", "event", name("before"), name("after"), (F.col("before") != F.col("after")).alias("legal"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(other, on).drop(*[f"__{k}" for k in keys])


def eligible(messages: DataFrame, found: DataFrame) -> DataFrame:
    """``messages`` with ``state``, the last one of :func:`steps` (pending without any), and ``refused``: that state where it is
    not accepted, else ``link`` where source_url is no link to a message; null where a message may be in an edition."""
    last = found.groupBy("message_id").agg(F.max(F.struct("seq", F.coalesce("event", F.lit("")).alias("event"), "after"))["after"].alias("state"))
    state = F.coalesce("state", F.lit(STATES[0]))
    rows = messages.join(last, "message_id", "left").withColumn("state", state)
    linked = F.coalesce(F.col("source_url").rlike(LINK), F.lit(False))
    return rows.withColumn("refused", F.when(F.col("state") != "accepted", F.col("state")).when(~linked, "link"))


def acted(entries: DataFrame, log: DataFrame, at: datetime | str | None = None) -> DataFrame:
    """Entries with each field that was set by hand as its last standing action says, as of an instant (all of the log, if none).

    ``log``: action_id, at, kind, period_key, message_pk, field, value, target. A ``set`` gives a field a value, and null empties
    it. ``undo`` and ``redo`` name the set that they take back or let stand again; the last one of a set counts, and one
    that is not later than its set never does. Order is by instant, then id. Without any standing action a field is the entry's own.
    Actions without id or instant, of unknown kinds, fields or entries are ignored.
    """
    seen = log.where("action_id is not null and at is not null")
    if at is not None:
        seen = seen.where(F.col("at") <= F.lit(at).cast("timestamp"))
    when = F.struct("at", "action_id")
    last = seen.where("kind in ('undo', 'redo')").groupBy(F.col("target").alias("__target")).agg(F.max(F.struct(when.alias("when"), "kind")).alias("__last"))
    sets = seen.where((F.col("kind") == "set") & F.col("field").isin(*FIELDS)).join(last, F.col("action_id") == F.col("__target"), "left")
    undone = (F.col("__last.kind") == "undo") & (F.col("__last.when") > when)
    newest = [F.max(F.when(F.col("field") == f, F.struct("at", "action_id", "value"))).alias(f"__{f}") for f in FIELDS]
    stand = sets.where(~F.coalesce(undone, F.lit(False))).groupBy("period_key", "message_pk").agg(*newest)
    rows = entries.join(stand, ["period_key", "message_pk"], "left")
    merged = rows.withColumns({f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.value")).otherwise(F.col(f)) for f in FIELDS})
    return merged.select(*entries.columns)

"""Queries over the driver's tables, each with the SQL that must give the same rows.

``orders`` stand in for messages, ``customer`` for senders, and status F for eligible entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.period import in_month, in_zoned_month
from ..operators import classify as C
from ..operators import edition as E
from ..operators import layout
from ..operators import merging as G
from ..operators import moderation as M
from ..operators import render as R
from ..operators import store as S
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MONTH = "1998-07"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("message_id"), T.source_url("market", F.col("o_orderkey")).alias("source_url"), F.col("o_orderpriority").alias("source_text"))


def entries(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    """Entries of all months or of one, whose range of dates then reaches the scan. Some have a title or category by hand, or
    are excluded."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = (o.where(in_month(F.col("o_orderdate"), period)) if period else o).join(c, o["o_custkey"] == c["c_custkey"])
    key = F.col("o_orderkey")
    return rows.select(key.alias("message_pk"), F.date_format("o_orderdate", "yyyy-MM").alias("period_key"), (F.col("o_orderstatus") == "F").cast("int").alias("eligible"), F.col("o_orderpriority").alias("category_title"), F.when(F.col("o_orderpriority").startswith("1"), "🔥").alias("category_emoji"), F.col("c_name").alias("short_title"), F.when(key % 10 == 3, "by <hand>").alias("manual_title"), F.when(key % 13 == 4, "Своё").alias("manual_category"), F.when(key % 11 == 5, "spam").alias("excluded_reason"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-08-01'")
def period_filter(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(in_month(F.col("o_orderdate"), MONTH)).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT doc_id, array_to_string(string_split(text, ' '), '') AS flat FROM documents")
def text_flatten(spark, sf_dir):
    rich = F.parse_json(F.to_json(F.struct(F.split("text", " ", -1).alias("a"))))
    return read(spark, sf_dir, "documents").select("doc_id", T.plain_text(F.variant_get(rich, "$.a", "variant")).alias("flat"))


@query(r"SELECT doc_id, s FROM (SELECT doc_id, regexp_replace(chr(9) || ' ' || text || ' ' || chr(10), '^[\t\n\r ]+|[\t\n\r ]+$', '', 'g') AS s FROM documents) WHERE s <> ''")
def strip_nonempty(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))
    return read(spark, sf_dir, "documents").select("doc_id", T.strip(padded).alias("s")).where("s != ''")


@query(r"SELECT doc_id, substring(regexp_replace('see https://a.example/' || doc_id || ' ' || text, 'https?://[^\s]+|\+?\d[\d ()-]{7,}', '', 'g'), 1, 420) AS clean FROM documents")
def contact_scrub(spark, sf_dir):
    linked = F.concat(F.lit("see https://a.example/"), F.col("doc_id"), F.lit(" "), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", T.scrub(linked).alias("clean"))


@query("SELECT o_orderkey, 'https://t.me/market/' || o_orderkey AS url FROM orders")
def source_url(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.source_url("market", F.col("o_orderkey")).alias("url"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT page_id, {ESCAPED.format('html')} AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.escape(F.col("html")).alias("escaped"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v FROM events")
def json_props(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0)).alias("v"))


TWICE = "(SELECT *, 0 AS pos FROM conversations UNION ALL SELECT conv_id, turn, role, 'later ' || text, 1 FROM conversations)"


def twice(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.withColumn("pos", F.lit(0)).union(c.select("conv_id", "turn", "role", F.concat(F.lit("later "), F.col("text")), F.lit(1)))


@query(f"SELECT conv_id, turn, text FROM {TWICE} QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) = 1")
def dedup_first(spark, sf_dir):
    return S.first_by(twice(spark, sf_dir), ["conv_id", "turn"], "pos").select("conv_id", "turn", "text")


@query(f"SELECT conv_id, turn, arg_max(text, pos) AS text FROM {TWICE} GROUP BY conv_id, turn")
def dedup_last(spark, sf_dir):
    return S.last_by(twice(spark, sf_dir), ["conv_id", "turn"], "pos").select("conv_id", "turn", "text")


@query("SELECT o_orderkey, 'old' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey % 3 = 0 AND p.o_orderkey = o.o_orderkey)")
def insert_if_absent(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    old = o.where("o_orderkey % 3 = 0")
    return old.withColumn("origin", F.lit("old")).union(S.absent(o, old, ["o_orderkey"]).withColumn("origin", F.lit("new")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1000 AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-08-01'")
def surrogate_ids(spark, sf_dir):
    return S.numbered(period_filter(spark, sf_dir).select("o_orderkey"), 1000, "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1000 AS id FROM orders")
def surrogate_ids_all_periods(spark, sf_dir):
    return S.numbered(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey", cell_rows=1 << 16)


@query("SELECT o_orderkey AS id, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey WHERE strftime(o_orderdate, '%Y-%m') = '1998-07' AND o_orderkey % 10 <> 3")
def classify_rows(spark, sf_dir):
    return C.requests(messages(spark, sf_dir), entries(spark, sf_dir), MONTH)


@query("SELECT c_custkey, CASE WHEN r_regionkey IS NULL THEN 'Другое' ELSE r_name END AS category_title, CASE WHEN r_regionkey IS NULL THEN '📦' ELSE NULL END AS category_emoji FROM customer LEFT JOIN region ON c_nationkey = r_regionkey")
def category_default(spark, sf_dir):
    cats = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("category_title"), F.lit(None).cast("string").alias("category_emoji"))
    return C.with_category(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), cats, "c_nationkey").drop("c_nationkey")


@query("(SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders)")
def id_set_diff(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return C.id_difference(a, read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")))


@query("""
SELECT o_orderkey AS message_pk, strftime(o_orderdate, '%Y-%m') AS period_key, CASE WHEN hit THEN 1 ELSE (o_orderstatus = 'F')::INT END AS eligible, CASE WHEN hit THEN 'h' ELSE 'old' END AS category_code,
 CASE WHEN hit THEN 'new' ELSE o_orderpriority END AS category_title, CASE WHEN hit THEN '🏠' WHEN o_orderpriority LIKE '1%' THEN '🔥' END AS category_emoji, CASE WHEN hit THEN 't' || o_orderkey ELSE c_name END AS short_title,
 CASE WHEN hit THEN NULL ELSE 'low' END AS confidence, CASE WHEN hit THEN 'fake' ELSE 'none' END AS provider, CASE WHEN o_orderkey % 10 = 3 THEN 'by <hand>' END AS manual_title
FROM (SELECT *, o_orderkey % 2 = 0 AND strftime(o_orderdate, '%Y-%m') = '1998-07' AS hit FROM orders JOIN customer ON o_custkey = c_custkey)""")
def apply_update(spark, sf_dir):
    new = messages(spark, sf_dir).where("id % 2 = 0").select("id", F.lit(1).alias("eligible"), F.lit("h").alias("category"), F.lit("new").alias("category_title"), F.lit("🏠").alias("category_emoji"), F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("string").alias("confidence"))
    old = entries(spark, sf_dir).withColumns({"category_code": F.lit("old"), "confidence": F.lit("low"), "provider": F.lit("none")})
    return C.updated(old, new, MONTH, "fake").drop("manual_category", "excluded_reason")


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), 'Объявление') AS title FROM customer")
def title_fallback(spark, sf_dir):
    manual = F.when(F.col("c_custkey") % 3 == 0, F.lit(""))
    short = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    return read(spark, sf_dir, "customer").select("c_custkey", T.first_filled(manual, short, F.lit(T.NO_TITLE)).alias("title"))


LINES = f"""lines AS (SELECT strftime(o_orderdate, '%Y-%m') AS period_key,
 row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderpriority NULLS FIRST, c_name NULLS FIRST, o_orderkey) AS rank, CASE WHEN o_orderpriority LIKE '1%' THEN '🔥' ELSE '📦' END AS emoji, CASE WHEN o_orderkey % 13 = 4 THEN 'Своё' ELSE o_orderpriority END AS category,
 '• ' || {ESCAPED.format("CASE WHEN o_orderkey % 10 = 3 THEN 'by <hand>' ELSE c_name END")} || chr(8239) || '<a href="https://t.me/market/' || o_orderkey || '">↗</a>' AS line
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderkey % 11 <> 5)"""
BLOCKS = f"""{LINES}, blocks AS (SELECT period_key, min(rank) AS ord, emoji || ' <b>' || {ESCAPED.format("category")} || '</b>' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS block FROM lines GROUP BY period_key, emoji, category)"""
PARTS = f"""{BLOCKS}, b AS (SELECT period_key, block, row_number() OVER (PARTITION BY period_key ORDER BY ord) AS n FROM blocks),
f AS (SELECT period_key, n, block, 1 AS part, length(block) AS size FROM b WHERE n = 1
 UNION ALL SELECT b.period_key, b.n, b.block, CASE WHEN f.size + length(b.block) + 2 > 3700 THEN f.part + 1 ELSE f.part END,
  CASE WHEN f.size + length(b.block) + 2 > 3700 THEN length(b.block) ELSE f.size + length(b.block) + 2 END FROM f JOIN b ON b.period_key = f.period_key AND b.n = f.n + 1),
p AS (SELECT period_key, part AS part_no, string_agg(block, chr(10) || chr(10) ORDER BY n) AS body FROM f GROUP BY period_key, part),
t AS (SELECT *, (count(*) OVER (PARTITION BY period_key))::INT AS total FROM p)
SELECT period_key, part_no, total, '📚 <b>обЪявления</b>' || chr(10) || 'Главное за ' || period_key || ' · Часть ' || part_no || ' из ' || total || chr(10) || chr(10) || body
 || CASE WHEN part_no = total THEN chr(10) || chr(10) || 'Актуальность уточняйте у автора.' || chr(10) || chr(10) || '<b>Новые объявления каждый день → обЪявления</b>' ELSE '' END AS html FROM t"""


@query(f"WITH {LINES} SELECT period_key, rank::INT AS rank, emoji, category, line FROM lines")
def digest_lines(spark, sf_dir):
    return R.lines(entries(spark, sf_dir), messages(spark, sf_dir))


@query(f"WITH {BLOCKS} SELECT period_key, ord::INT AS ord, block FROM blocks")
def digest_blocks(spark, sf_dir):
    return R.blocks(digest_lines(spark, sf_dir))


def _most(spark, sf_dir) -> int:
    """The most orders of a month, and so of blocks: one scan of one column."""
    return read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM")).count().agg(F.max("count")).collect()[0][0] or 0


@query(f"WITH RECURSIVE {PARTS} WHERE period_key = '1998-07'")
def digest_parts(spark, sf_dir):
    return R.digest(entries(spark, sf_dir, period=MONTH), messages(spark, sf_dir), most=_most(spark, sf_dir))


@query(f"WITH RECURSIVE {PARTS}")
def digest_all_periods(spark, sf_dir):
    return R.digest(entries(spark, sf_dir), messages(spark, sf_dir), most=_most(spark, sf_dir))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of a chat export: other types, ids that are strings, dates that are none, senders and texts of all kinds."""
    key = F.col("o_orderkey")
    odd = lambda n, r: key % n == r
    item = F.struct(
        F.when(F.col("o_orderstatus") == "P", "service").otherwise("message").alias("type"),
        F.when(odd(11, 3), F.to_json(F.struct(key.cast("string").alias("id")))).otherwise(F.to_json(F.struct(key.alias("id")))).alias("ids"),
        F.when(odd(7, 1), "no date").when(odd(13, 2), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("date"),
        F.when(odd(5, 0), F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("from"),
        F.when(odd(17, 4), F.array(F.lit("  "), F.lit("\n"))).otherwise(F.array(F.lit(" "), F.col("o_orderpriority"), F.lit(" +"), F.col("o_orderstatus"), F.lit("\t"))).alias("text"),
    )
    rows = read(spark, sf_dir, "orders").select(key.alias("pos"), item.alias("m"))
    # the id's own JSON type is kept, so it joins the other members as text
    joined = F.concat(F.expr("substring(m.ids, 1, length(m.ids) - 1)"), F.lit(","), F.expr("substring(to_json(struct(m.type, m.date, m.`from`, m.text)), 2)"))
    return rows.select("pos", F.parse_json(joined).alias("m"))


@query("""
SELECT o_orderkey AS message_id, 'c1' AS chat_id, CASE WHEN o_orderkey % 13 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS published_at,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS sender_name, o_orderpriority || ' +' || o_orderstatus AS source_text, 'https://t.me/market/' || o_orderkey AS source_url
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 3 AND o_orderkey % 7 <> 1 AND o_orderkey % 17 <> 4
 AND o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-08-01'""")
def qualifying_messages(spark, sf_dir):
    from ..sources import export

    return export.qualifying(_exported(spark, sf_dir), MONTH, "c1", "market").select("message_id", "chat_id", "published_at", "sender_name", "source_text", "source_url")


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS period_key, o_orderkey AS id, (o_orderkey % 5 IN (0, 4))::INT AS eligible, o_orderpriority AS category,
       CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority || ' ```' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'high' END AS confidence,
       CASE WHEN o_orderpriority LIKE '5%' THEN 'Другое' WHEN o_orderpriority LIKE '4%' THEN NULL ELSE 'Title ' || o_orderpriority END AS category_title
FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1995-05'""")
def decoded_reply(spark, sf_dir):
    """A reply for each month's orders, most in a fence amid prose, one not valid: the last entry of an id and the last category
    of a code count."""
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period_key"), "o_orderkey", "o_orderpriority")
    include = F.element_at(F.array(*map(F.lit, ("true", "0", '""', "[]", '"no"'))), (key % 5 + 1).cast("int"))
    entry = lambda title: F.concat(F.lit('{"id":'), key, F.lit(',"include":'), include, F.lit(',"category":"'), F.col("o_orderpriority"), F.lit('","title":"'), title, F.lit('","confidence":'), F.when(key % 2 == 0, '"high"').otherwise("null"), F.lit("}"))
    first = entry(F.concat("o_orderpriority", F.lit(" ```")))
    entries_ = F.when(key % 7 == 0, F.concat(first, F.lit(","), entry(F.lower("o_orderpriority")))).otherwise(first)
    category = lambda title: F.concat(F.lit('{"code":"'), F.col("o_orderpriority"), F.lit('","title":'), title, F.lit("}"))
    named = F.when(F.col("o_orderpriority").startswith("4"), F.lit("null")).otherwise(F.concat(F.lit('"Title '), "o_orderpriority", F.lit('"')))
    known = F.when(~F.col("o_orderpriority").startswith("5"), F.concat(category(F.lit('"first"')), F.lit(","), category(named)))
    body = rows.groupBy("period_key").agg(F.array_join(F.collect_list(entries_), ",").alias("e"), F.array_join(F.collect_set(known), ",").alias("c"))
    text = F.concat(F.lit('{"categories":['), "c", F.lit('],"entries":['), "e", F.lit("]}"))
    text = F.when(F.col("period_key") == "1995-05", F.substring(text, 1, 40)).when(F.col("period_key").endswith("01"), text).otherwise(F.concat(F.lit("so: ```json\n"), text, F.lit("\n``` done ```")))
    cats, found = C.replies(body.select("period_key", text.alias("reply")))
    cats = cats.withColumnRenamed("code", "__code")
    joined = found.join(cats, (found["period_key"] == cats["period_key"]) & found["category"].eqNullSafe(cats["__code"]), "left")
    title = F.when(cats["__code"].isNull(), T.NO_CATEGORY).otherwise(cats["category_title"])
    return joined.select(found["period_key"], "id", "eligible", "category", "title", "confidence", title.alias("category_title"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS utc FROM (SELECT event_id, ts - INTERVAL 10 DAY AS ts FROM events) WHERE ts >= TIMESTAMP '2023-12-31 23:00:00' AND ts < TIMESTAMP '2024-01-31 23:00:00'")
def zoned_month(spark, sf_dir):
    """Events ten days earlier, so that some are of the month before."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("ts") - F.expr("interval 10 days")).alias("ts"))
    return e.where(in_zoned_month(F.col("ts"), "2024-01")).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("utc"))


def _chats(spark, sf_dir) -> DataFrame:
    """Orders as messages of a customer's chat; some are albums, some have no text."""
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  \n"), F.col("o_orderstatus")))
    group = F.when(key % 3 > 0, F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("chat_id"), key.alias("message_id"), group.alias("media_group_id"), text.alias("source_text"))


CHATS = "chats AS (SELECT o_custkey % 50 AS chat_id, o_orderkey AS message_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS media_group_id, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 > 0 THEN o_orderpriority || ' ' || o_orderstatus END AS words FROM orders)"


@query(f"""WITH {CHATS} SELECT chat_id, min(message_id) AS message_id, count(*) AS messages, arg_min(words, message_id) FILTER (WHERE words IS NOT NULL) AS words,
 CASE WHEN count(words) = 0 THEN 'needs_review' ELSE 'ready' END AS status FROM chats GROUP BY chat_id, media_group_id, CASE WHEN media_group_id IS NULL THEN message_id END""")
def album_entries(spark, sf_dir):
    return E.albums(_chats(spark, sf_dir))


def _updates(spark, sf_dir) -> DataFrame:
    """Orders as live updates; every sixth is followed by an edit, which arrives twice."""
    key, at = F.col("o_orderkey"), F.lit(1_700_000_000) + F.col("o_orderkey")
    text = F.when(key % 5 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    body = lambda edit, words, caption: F.struct(key.alias("message_id"), F.struct((F.col("o_custkey") % 50).alias("id")).alias("chat"), at.alias("date"), edit.cast("long").alias("edit_date"), words.alias("text"), caption.alias("caption"), F.lit(None).cast("string").alias("media_group_id"))
    o = read(spark, sf_dir, "orders")
    new = body(F.lit(None), text, F.when(key % 10 == 0, F.lit(" on  it ")).cast("string"))
    old = body(at + 60, F.concat(F.lit("now "), F.col("o_orderstatus")), F.lit(None).cast("string"))
    sent = o.select((key * 2).alias("update_id"), new.alias("message"), F.lit(None).cast(live.UPDATE.partition("edited_message ")[2]).alias("edited_message"))
    edits = o.where("o_orderkey % 6 = 0").select((key * 2 + 1).alias("update_id"), F.lit(None).cast(live.UPDATE.partition("edited_message ")[2]).alias("message"), old.alias("edited_message"))
    return sent.union(edits).union(edits)


@query("""SELECT o_custkey % 50 AS chat_id, o_orderkey AS message_id, CASE WHEN o_orderkey % 6 = 0 THEN 'now ' || o_orderstatus WHEN o_orderkey % 10 = 0 THEN 'on it' WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS words,
 CASE WHEN o_orderkey % 6 > 0 AND o_orderkey % 10 > 0 AND o_orderkey % 5 = 0 THEN 'needs_review' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END::BIGINT AS edits FROM orders""")
def live_messages(spark, sf_dir):
    return live.latest(live.captured(_updates(spark, sf_dir))).select("chat_id", "message_id", "words", "status", "edits")


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(to_timestamp(1700000000 + o_orderkey) AT TIME ZONE 'UTC', '%Y-%m') END AS period_key, (o_custkey % 50)::VARCHAR AS chat_id, o_orderkey AS message_id,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'now ' || o_orderstatus WHEN o_orderkey % 10 = 0 THEN 'on it' WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS words, o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 AS deleted FROM orders""")
def live_states(spark, sf_dir):
    """The states of live updates that come in two batches, edits and deletions first; every seventh message never comes."""
    rows = _updates(spark, sf_dir).where("coalesce(message.message_id, edited_message.message_id) % 7 != 0").withColumn("deleted_business_messages", F.lit(None).cast(live.DELETION.partition(" ")[2]))
    o = read(spark, sf_dir, "orders").where("o_orderkey % 7 = 0 or o_orderkey % 9 = 0")
    gone = o.select((F.col("o_orderkey") * 2 + 10**9).alias("update_id"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("message", "edited_message")], F.struct(F.struct((F.col("o_custkey") % 50).alias("id")).alias("chat"), F.array("o_orderkey").alias("message_ids")).alias("deleted_business_messages"))
    first = live.states(live.changes(rows.where("edited_message is not null").union(gone)))
    second = live.states(live.changes(rows.where("message is not null")))
    return live.states(first.union(second).union(first)).select("period_key", "chat_id", "message_id", "words", "deleted")


@query("""
SELECT o_orderkey AS message_id, epoch(o_orderdate)::BIGINT - 7200 AS sent, CASE WHEN o_orderkey % 17 <> 4 THEN o_orderpriority || ' +' || o_orderstatus END AS words, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS sender_name
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 3 AND o_orderkey % 7 <> 1 AND o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-08-01'""")
def export_states(spark, sf_dir):
    """A summer month of Madrid, two hours before that of UTC; messages without text are kept."""
    from ..sources import export

    found = export.told(_exported(spark, sf_dir), MONTH, "c1", "Europe/Madrid")
    return found.select("message_id", F.unix_seconds("sent_at").alias("sent"), "words", "sender_name")


@query(f"""WITH {CHATS}, e AS (SELECT *, CASE WHEN message_id % 9 = 2 THEN 'deleted' WHEN message_id % 11 = 5 THEN 'spam' END AS was FROM chats),
 a AS (SELECT *, media_group_id IS NOT NULL AND was IS DISTINCT FROM 'deleted' AS alive FROM e),
 g AS (SELECT chat_id, media_group_id, min(message_id) AS first_id, arg_min(words, message_id) FILTER (WHERE words IS NOT NULL) AS album_words FROM a WHERE alive GROUP BY chat_id, media_group_id)
SELECT message_id, CASE WHEN alive AND was IS NULL THEN CASE WHEN message_id <> first_id THEN 'album' WHEN album_words IS NULL THEN 'needs_review' END ELSE was END AS excluded_reason,
 CASE WHEN alive AND message_id = first_id THEN coalesce(album_words, words) ELSE words END AS words FROM a LEFT JOIN g USING (chat_id, media_group_id)""")
def album_texts(spark, sf_dir):
    """Which message stands for its album, and with what text, where some messages are deleted or excluded."""
    key = F.col("message_id")
    rows = _chats(spark, sf_dir).withColumn("id", key)
    given = rows.select(key.alias("message_pk"), F.when(key % 9 == 2, E.DELETED).when(key % 11 == 5, "spam").alias("excluded_reason"))
    shown = E.by_album(rows, given)
    return E.spoken(rows, shown).join(shown, F.col("id") == F.col("message_pk")).select("message_id", "excluded_reason", F.nullif(E.prepared(F.col("source_text")), F.lit("")).alias("words"))


@query("SELECT doc_id, sha256(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS text_hash FROM documents")
def composed_texts(spark, sf_dir):
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(E.normalised(apart), 256).alias("text_hash"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_custkey % 50 AS chat_id, strftime(o_orderdate, '%Y-%m') AS m, CASE WHEN o_orderkey % 17 = 6 THEN 'needs_review' WHEN o_orderkey % 11 = 5 THEN 'spam' END AS why,
  CASE WHEN o_orderkey % 10 = 3 THEN 'by <hand>' WHEN o_orderkey % 19 = 7 THEN c_name || c_name || c_name WHEN o_orderkey % 23 <> 8 THEN c_name END AS title, CASE WHEN o_orderkey % 13 = 4 THEN 'Своё' ELSE o_orderpriority END AS category, o_orderstatus = 'F' AS ok
  FROM orders JOIN customer ON o_custkey = c_custkey),
 s AS (SELECT *, count(*) OVER (PARTITION BY m, category, title) AS n FROM e WHERE ok AND why IS NULL),
 g AS (SELECT chat_id, k, lag(k) OVER (PARTITION BY chat_id ORDER BY k) AS before FROM (SELECT o_custkey % 50 AS chat_id, o_orderkey AS k FROM orders))
SELECT 'needs_review' AS kind, chat_id, k AS first_id, k AS last_id, title FROM e WHERE why = 'needs_review'
UNION ALL SELECT 'no title', chat_id, k, k, title FROM s WHERE title IS NULL
UNION ALL SELECT 'long title', chat_id, k, k, title FROM s WHERE length(title) > 42
UNION ALL SELECT 'same title', chat_id, k, k, title FROM s WHERE title IS NOT NULL AND n > 1
UNION ALL SELECT 'gap', chat_id, before + 1, k - 1, NULL FROM g WHERE k - before > 1""")
def edition_warnings(spark, sf_dir):
    """Entries of all months, some without a title, with a long one, or waiting for a review."""
    key = F.col("message_pk")
    rows = entries(spark, sf_dir).withColumns({"short_title": F.when(key % 19 == 7, F.repeat("short_title", F.lit(3))).when(key % 23 != 8, F.col("short_title")), "excluded_reason": F.when(key % 17 == 6, E.REVIEW).otherwise(F.col("excluded_reason"))})
    chats = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("chat_id"), F.col("o_orderkey").alias("message_id"))
    return E.warnings(rows, chats)


@query(f"WITH {CHATS} SELECT chat_id, before + 1 AS first_missing, message_id - 1 AS last_missing FROM (SELECT chat_id, message_id, lag(message_id) OVER (PARTITION BY chat_id ORDER BY message_id) AS before FROM chats) WHERE message_id - before > 1")
def missing_messages(spark, sf_dir):
    return E.gaps(_chats(spark, sf_dir), 1 << 10)


@query(f"""WITH {CHATS} SELECT message_id, CASE WHEN message_id % 4 = 0 AND message_id % 8 > 0 THEN words || ' 2' ELSE words END AS words,
 message_id % 4 = 0 AND message_id % 8 > 0 AND words IS NOT NULL AS changed FROM chats""")
def edited_messages(spark, sf_dir):
    """Every fourth message is edited twice; the later edit changes the text of every other one of them."""
    rows = _chats(spark, sf_dir).select("message_id", "source_text")
    some = rows.where("message_id % 4 = 0")
    first = some.select("message_id", F.lit(1).alias("edited_at"), F.lit("gone").alias("source_text"))
    last = some.select("message_id", F.lit(2).alias("edited_at"), F.when(F.col("message_id") % 8 > 0, F.when(E.prepared(F.col("source_text")) != "", F.concat("source_text", F.lit(" 2")))).otherwise(F.col("source_text")).alias("source_text"))
    words = F.nullif(E.prepared(F.col("source_text")), F.lit(""))
    found = E.edited(rows, first.union(last), ["message_id"])
    return found.select("message_id", words.alias("words"), (F.col("changed") & words.isNotNull()).alias("changed"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS text_hash FROM documents WHERE trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) NOT IN (SELECT trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) FROM documents WHERE doc_id % 3 = 0)")
def uncached_texts(spark, sf_dir):
    """Documents whose text is not among those that already have a result."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"))
    known = d.where("doc_id % 3 = 0").select(E.text_hash(F.col("source_text")).alias("text_hash"))
    return E.uncached(d, known).select("doc_id", "text_hash")


RULED = """ruled AS (SELECT doc_id, w, substring(w, 1, 35) AS head FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), '') AS w FROM documents)),
 titled AS (SELECT doc_id, CASE WHEN length(w) <= 34 THEN w WHEN contains(head, ' ') THEN regexp_replace(head, ' [^ ]*$', '') ELSE substring(w, 1, 34) END AS title FROM ruled)"""


@query(f"""WITH {RULED} SELECT doc_id, CASE WHEN title IS NOT NULL THEN 'other' END AS category, title, CASE WHEN title IS NULL THEN 'needs_review' ELSE 'ready' END AS status,
 CASE WHEN length(title) <= 28 THEN 'target' WHEN length(title) <= 34 THEN 'preferred' WHEN title IS NOT NULL THEN 'too long' END AS grade FROM titled""")
def ruled_titles(spark, sf_dir):
    found = E.by_rule(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text")))
    return found.select("doc_id", "category", "title", "status", E.title_grade(F.col("title")).alias("grade"))


@query(f"WITH {RULED} SELECT doc_id, count(*) OVER (PARTITION BY title, lang) > 1 AS duplicate FROM titled JOIN documents USING (doc_id)")
def duplicate_titles(spark, sf_dir):
    found = E.by_rule(read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("source_text")))
    return E.duplicate_titles(found, ["title", "lang"]).select("doc_id", "duplicate")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS period_key, (o_orderkey % 100)::INT AS part_no, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_custkey % 2 = 0 AND strftime(p.o_orderdate, '%Y-%m') = strftime(o.o_orderdate, '%Y-%m') AND p.o_orderkey % 100 = o.o_orderkey % 100)")
def unsent_parts(spark, sf_dir):
    """Orders as parts; those of status F are logged, and have a message id where the customer's key is even."""
    o = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period_key"), (F.col("o_orderkey") % 100).cast("int").alias("part_no"), "o_orderkey", "o_custkey", "o_orderstatus")
    log = o.where("o_orderstatus = 'F'").select("period_key", "part_no", F.lit("here").alias("destination"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey")).alias("telegram_message_id"))
    elsewhere = o.select("period_key", "part_no", F.lit("elsewhere").alias("destination"), F.col("o_orderkey").alias("telegram_message_id"))
    return E.unsent(o.select("period_key", "part_no", "o_orderkey"), log.union(elsewhere), "here")


SPLIT = 400


@query(f"""WITH RECURSIVE {LINES}, g AS (SELECT period_key, emoji, category, line, rank, row_number() OVER w AS n, first_value(rank) OVER w AS ord, {SPLIT} - length(emoji || ' <b>' || {ESCAPED.format("category")} || '{E.MORE}</b>') - 1 AS room
 FROM lines WINDOW w AS (PARTITION BY period_key, emoji, category ORDER BY rank)),
f AS (SELECT period_key, ord, category, emoji, n, line, 0 AS piece, length(line) AS size FROM g WHERE n = 1
 UNION ALL SELECT g.period_key, g.ord, g.category, g.emoji, g.n, g.line, CASE WHEN f.size + 1 + length(g.line) > g.room THEN f.piece + 1 ELSE f.piece END, CASE WHEN f.size + 1 + length(g.line) > g.room THEN length(g.line) ELSE f.size + 1 + length(g.line) END
 FROM f JOIN g ON g.period_key = f.period_key AND g.ord = f.ord AND g.n = f.n + 1)
SELECT period_key, ord::INT AS ord, piece, any_value(emoji) || ' <b>' || {ESCAPED.format("any_value(category)")} || CASE WHEN piece > 0 THEN '{E.MORE}' ELSE '' END || '</b>' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS block FROM f GROUP BY period_key, ord, piece""")
def split_blocks(spark, sf_dir):
    """Blocks of all months, split where they pass 400 code points."""
    return E.split_blocks(digest_lines(spark, sf_dir), SPLIT)


#: Orders' lines as actions on the orders' entries (SQL): some lines set a field, others undo or redo the set of a line.
ACTIONS = """log AS (SELECT l_orderkey * 10 + l_linenumber AS action_id, l_shipdate AS happened, CASE WHEN l_linenumber IN (4, 6) THEN 'undo' WHEN l_linenumber = 5 THEN 'redo' ELSE 'set' END AS kind, l_orderkey,
 CASE l_returnflag WHEN 'A' THEN 'manual_title' WHEN 'N' THEN 'excluded_reason' ELSE 'manual_category' END AS field, CASE WHEN l_quantity > 5 THEN 'v' || l_partkey END AS value, l_orderkey * 10 + 1 + l_orderkey % 3 AS target
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01')"""


def _actions(spark, sf_dir) -> DataFrame:
    """As ``ACTIONS`` says, of all instants, and each twice."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(line.isin(4, 6), "undo").when(line == 5, "redo").otherwise("set")
    field = F.when(F.col("l_returnflag") == "A", "manual_title").when(F.col("l_returnflag") == "N", "excluded_reason").otherwise("manual_category")
    value = F.when(F.col("l_quantity") > 5, F.concat(F.lit("v"), "l_partkey"))
    lines = read(spark, sf_dir, "lineitem").select((key * 10 + line).alias("action_id"), F.col("l_shipdate").alias("at"), kind.alias("kind"), key.alias("message_pk"), field.alias("field"), value.alias("value"), (key * 10 + 1 + key % 3).alias("target"))
    months = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_pk"), F.date_format("o_orderdate", "yyyy-MM").alias("period_key"))
    rows = lines.join(months, "message_pk")
    return rows.union(rows)


@query(f"""WITH {ACTIONS}, stood AS (SELECT * FROM log s WHERE kind = 'set' AND coalesce((SELECT arg_max(kind, (t.happened, t.action_id)) FROM log t WHERE t.kind <> 'set' AND t.target = s.action_id AND (t.happened, t.action_id) > (s.happened, s.action_id)), 'redo') = 'redo'),
 newest AS (SELECT l_orderkey, field, value FROM stood QUALIFY row_number() OVER (PARTITION BY l_orderkey, field ORDER BY happened DESC, action_id DESC, value DESC NULLS LAST) = 1),
 own AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'by <hand>' END AS manual_title, CASE WHEN o_orderkey % 13 = 4 THEN 'Своё' END AS manual_category, CASE WHEN o_orderkey % 11 = 5 THEN 'spam' END AS excluded_reason FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS message_pk, CASE WHEN a.field IS NULL THEN manual_title ELSE a.value END AS manual_title, CASE WHEN b.field IS NULL THEN manual_category ELSE b.value END AS manual_category,
 CASE WHEN c.field IS NULL THEN excluded_reason ELSE c.value END AS excluded_reason FROM own
 LEFT JOIN newest a ON a.l_orderkey = o_orderkey AND a.field = 'manual_title' LEFT JOIN newest b ON b.l_orderkey = o_orderkey AND b.field = 'manual_category' LEFT JOIN newest c ON c.l_orderkey = o_orderkey AND c.field = 'excluded_reason'""")
def admin_edits(spark, sf_dir):
    """Fields set by hand as of the beginning of 1998."""
    return M.acted(entries(spark, sf_dir), _actions(spark, sf_dir), "1998-01-01").select("message_pk", *M.FIELDS)


MODERATED = """ev AS (SELECT user_id AS message_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'accept' WHEN 'view' THEN 'reject' WHEN 'click' THEN 'exclude' WHEN 'purchase' THEN 'restore' WHEN 'error' THEN CASE WHEN value > 200 THEN 'delete' ELSE 'error' END END AS event FROM events),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS n FROM ev),
 steps AS (SELECT message_id, 0::BIGINT AS seq, ''::VARCHAR AS event, 0::BIGINT AS n, 'pending' AS before, 'pending' AS after FROM (SELECT DISTINCT message_id FROM ev)
  UNION ALL SELECT e.message_id, e.seq, e.event, e.n, s.after, CASE
   WHEN e.event = 'accept' AND s.after IN ('pending', 'rejected') THEN 'accepted' WHEN e.event = 'reject' AND s.after IN ('pending', 'accepted') THEN 'rejected'
   WHEN e.event = 'exclude' AND s.after = 'accepted' THEN 'excluded' WHEN e.event = 'restore' AND s.after = 'excluded' THEN 'accepted' WHEN e.event = 'delete' THEN 'deleted' ELSE s.after END
  FROM steps s JOIN numbered e ON e.message_id = s.message_id AND e.n = s.n + 1)"""


def _moderated(spark, sf_dir) -> DataFrame:
    """Events as decisions about messages, one for each user."""
    kinds = {"signup": "accept", "view": "reject", "click": "exclude", "purchase": "restore"}
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 200), "delete").when(F.col("event_type") == "error", "error")
    for a, b in kinds.items():
        kind = kind.when(F.col("event_type") == a, b)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("seq"), kind.alias("event"))


@query(f"WITH RECURSIVE {MODERATED} SELECT message_id, seq, event, before, after, before <> after AS legal FROM steps WHERE n > 0")
def moderation_steps(spark, sf_dir):
    return M.steps(_moderated(spark, sf_dir), 1 << 12)


@query(f"""WITH RECURSIVE {MODERATED}, last AS (SELECT message_id, arg_max(after, n) AS state FROM steps GROUP BY message_id)
SELECT c_custkey AS message_id, coalesce(state, 'pending') AS state, CASE WHEN coalesce(state, 'pending') <> 'accepted' THEN coalesce(state, 'pending') WHEN c_custkey % 3 = 0 THEN 'link' END AS refused FROM customer LEFT JOIN last ON message_id = c_custkey""")
def eligible_messages(spark, sf_dir):
    """Customers as messages; every third has a link to a group alone."""
    key = F.col("c_custkey")
    url = F.when(key % 3 == 0, "https://t.me/market").otherwise(T.source_url("market", key))
    rows = read(spark, sf_dir, "customer").select(key.alias("message_id"), url.alias("source_url"))
    return M.eligible(rows, M.steps(_moderated(spark, sf_dir), 1 << 12)).select("message_id", "state", "refused")


def merged_categories(spark, sf_dir):
    """Documents as entries of a language's edition, in categories of up to three; no SQL, as rounds go on until none is small."""
    found = E.by_rule(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("source_text")))
    named = F.concat(F.col("source"), F.lit("/"), F.expr("doc_id div 3"))
    return G.merged(found.select(F.col("lang").alias("period_key"), named.alias("category"), "title"))


QUERIES["merged_categories"] = merged_categories
PAGE = 500
_FOOT = layout.footer("обЪявления", "https://t.me/").replace("\n", "' || chr(10) || '")
_HEAD = "CASE WHEN {part} = 1 THEN '📚 <b>обЪявления</b>' || chr(10) || 'Главное за ' || month || ' · Часть ' ELSE '📚 <b>обЪявления</b> · ' || month || chr(10) || 'Часть ' END || {part} || ' из ' || {total} || chr(10) || chr(10)"
_FITS = f"p.used + 2 + c.size <= {PAGE} - length({_HEAD.format(part='p.part', total=chr(39) * 2)}) - c.digits"


@query(ORACLE_SQL["split_blocks"].replace("\nSELECT period_key, ord::INT AS ord", ",\ns AS (SELECT period_key, ord").rstrip() + f"""),
 b AS (SELECT period_key, block, row_number() OVER (PARTITION BY period_key ORDER BY ord, piece) AS n, count(*) OVER (PARTITION BY period_key) AS blocks,
  list_extract({list(layout.MONTHS)}, substring(period_key, 6, 2)::INT) || ' ' || substring(period_key, 1, 4) AS month FROM s),
 c AS (SELECT *, length(block) + CASE WHEN n = blocks THEN length('{_FOOT}') ELSE 0 END AS size, unnest(range(1, length(blocks::VARCHAR) + 1)) AS digits FROM b),
 p AS (SELECT period_key, digits, n, block, month, 1 AS part, size AS used FROM c WHERE n = 1
  UNION ALL SELECT c.period_key, c.digits, c.n, c.block, c.month, CASE WHEN {_FITS.replace("month", "c.month")} THEN p.part ELSE p.part + 1 END, CASE WHEN {_FITS.replace("month", "c.month")} THEN p.used + 2 + c.size ELSE c.size END
  FROM p JOIN c ON c.period_key = p.period_key AND c.digits = p.digits AND c.n = p.n + 1),
 least AS (SELECT period_key, digits, parts FROM (SELECT period_key, digits, max(part) AS parts FROM p GROUP BY period_key, digits) WHERE length(parts::VARCHAR) <= digits QUALIFY row_number() OVER (PARTITION BY period_key ORDER BY digits) = 1),
 whole AS (SELECT period_key, part AS part_no, any_value(parts) AS total, any_value(month) AS month, string_agg(block, chr(10) || chr(10) ORDER BY n) AS body FROM p JOIN least USING (period_key, digits) GROUP BY period_key, part)
SELECT period_key, part_no, total, {_HEAD.format(part="part_no", total="total")} || body || CASE WHEN part_no = total THEN '{_FOOT}' ELSE '' END AS html FROM whole""")
def edition_pages(spark, sf_dir):
    """Split blocks of all months in parts of 500 code points, headers and footers included."""
    rows = split_blocks(spark, sf_dir)
    return layout.paged(rows.select("period_key", F.struct("ord", "piece").alias("ord"), "block"), PAGE)

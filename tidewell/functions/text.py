"""Scalar functions of the digest, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text handling strips it (fixed values); Spark's trim and Java's \s know fewer.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Digest constants (fixed values).
LIMIT, SCRUB_CHARS = 3700, 420
NO_TITLE, NO_CATEGORY, NO_EMOJI = "Объявление", "Другое", "📦"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def scrub(text: Column) -> Column:
    """Links and telephone numbers go, then the first 420 characters stay."""
    return F.substring(F.regexp_replace(text, rf"https?://[^{SPACE}]+|\+?\p{{Nd}}[\p{{Nd}} ()-]{{7,}}", ""), 1, SCRUB_CHARS)


def escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def source_url(username: str, message_id: Column) -> Column:
    return F.concat(F.lit(f"https://t.me/{username}/"), message_id.cast("string"))


def plain_text(value: Column) -> Column:
    """Rich text as a variant: a string is itself, an array joins its strings and its objects' texts, all else is empty."""
    part = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), part)
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, "")).otherwise(F.lit(""))


def line(title: Column, url: Column) -> Column:
    return F.concat(F.lit("• "), escape(title), F.lit('\u202f<a href="'), escape(url), F.lit('">↗</a>'))


def block(emoji: Column, title: Column, lines: Column) -> Column:
    return F.concat(emoji, F.lit(" <b>"), escape(title), F.lit("</b>\n"), F.array_join(lines, "\n"))


def packed(blocks: Column, limit: Column | int = LIMIT, gap: str = "\n\n") -> Column:
    """Ordered blocks into bodies, with a gap between them: a block joins the last body unless that would pass the limit."""
    def add(acc: Column, b: Column) -> Column:
        n = F.size(acc)
        tail = F.when(n > 0, F.element_at(acc, F.greatest(n, F.lit(1)))).otherwise("")
        fits = (n > 0) & ((F.length(tail) == 0) | (F.length(tail) + F.length(b) + len(gap) <= limit))
        joined = F.concat(tail, F.when(F.length(tail) > 0, F.lit(gap)).otherwise(""), b)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(b)))

    return F.aggregate(blocks, F.array().cast("array<string>"), add)


def envelope(body: Column, period: Column, part: Column, total: Column, brand: str) -> Column:
    head = F.concat(F.lit(f"📚 <b>{brand}</b>\nГлавное за "), period, F.lit(" · Часть "), part.cast("string"), F.lit(" из "), total.cast("string"), F.lit("\n\n"))
    foot = F.lit(f"\n\nАктуальность уточняйте у автора.\n\n<b>Новые объявления каждый день → {brand}</b>")
    return F.concat(head, body, F.when(part == total, foot).otherwise(""))

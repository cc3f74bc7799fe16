"""python -m tidewell.cli import FILE --period P | classify --period P | preview --period P [--send] | publish --period P | warnings --period P
| set ENTRY FIELD [VALUE] --period P --actor A | undo ACTION --period P --actor A | redo ACTION --period P --actor A"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.store import Store
from .plans import digest
from .sources import remote
from .sources.settings import settings


def warn(rows: DataFrame) -> None:
    """A line each, on standard error."""
    for r in rows.orderBy("kind", "chat_id", "first_id").toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r), file=sys.stderr)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("import", "classify", "preview", "publish", "warnings", "set", "undo", "redo"):
        one = commands.add_parser(name)
        one.add_argument("--period", required=True)
        if name == "import":
            one.add_argument("file")
        if name == "preview":
            one.add_argument("--send", action="store_true")
        if name in ("set", "undo", "redo"):
            one.add_argument("--actor", required=True)
            one.add_argument("of", type=int)
        if name == "set":
            one.add_argument("field")
            one.add_argument("value", nargs="?")
    a, s = parser.parse_args(args), settings(digest.root())
    spark = SparkSession.builder.appName("digest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, s.store)
    if a.command == "import":
        known = (spark, store, a.file, a.period, s.source_chat_id, s.source_username)
        print(digest.import_by_rules(*known, s.zone) if s.rules else digest.import_export(*known))
    elif a.command == "classify":
        run = digest.classify_by_rules if s.rules else digest.classify
        print(run(spark, store, a.period, remote.providers(s), s.place))
    elif a.command == "warnings":
        warn(digest.warnings(store, a.period))
    elif a.command == "publish":
        if s.rules:
            warn(digest.warnings(store, a.period))
        digest.publish_rest(store, a.period, remote.send, s.bot_token, s.source_chat_id, s.brand, s.group_link)
    elif a.command == "set":
        print(digest.act(store, a.period, a.actor, "set", a.of, a.field, a.value))
    elif a.command in ("undo", "redo"):
        print(digest.act(store, a.period, a.actor, a.command, target=a.of))
    else:
        parts = digest.render(store, a.period, s.brand, s.group_link)
        if a.command == "preview" and not a.send:
            print("\n\n--- PART ---\n".join(parts))
        else:
            digest.publish(parts, remote.send, s.bot_token, s.admin_chat_id)


if __name__ == "__main__":
    main()

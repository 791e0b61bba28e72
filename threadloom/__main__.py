"""python -m threadloom inspect PATH | import PATH STORE | topics STORE: counters as JSON on stdout."""

from __future__ import annotations

import json
import sys

from threadloom.api import Api, rows
from threadloom.operators.store import Store
from threadloom.session import session
from threadloom.sources import chat_export, importer


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if len(args) < 2 or args[0] not in ("inspect", "import", "topics") or args[0] == "import" and len(args) < 3:
        print(__doc__, file=sys.stderr)
        return 2
    spark = session()
    try:
        if args[0] == "inspect":
            out = rows(chat_export.inspect(spark, args[1]))[0]
        elif args[0] == "import":
            out = importer.import_export(spark, args[1], Store(spark, args[2]))
        else:
            out = Api(spark, Store(spark, args[1])).build_topics()
    except chat_export.ExportError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())

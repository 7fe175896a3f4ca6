"""Command line: another path prefix in an index, without building it anew.

    python -m loregrid.plans.remap --config config.json --to /new/root [--from /old/root] [--dry-run]

The versions before the change stay beside the new ones; if a table can't be written, those written before it go back.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from loregrid.plans.api import KnowledgeBase
from loregrid.sources.files import Settings


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Another path prefix in an index, without building it anew.")
    parser.add_argument("--config", default="config.json", help="the settings file")
    parser.add_argument("--from", dest="old", help="the prefix to be replaced; found in the index where it isn't given")
    parser.add_argument("--to", dest="new", help="the new prefix; the settings' kb_root where it isn't given")
    parser.add_argument("--dry-run", action="store_true", help="count, and change nothing")
    given = parser.parse_args(args)
    settings = Settings.load(given.config)
    kb = KnowledgeBase(spark or SparkSession.builder.appName("remap").getOrCreate(), settings)
    try:
        result = kb.remap(given.new or settings.kb_root, given.old, given.dry_run)
    except Exception as error:
        print(json.dumps({"status": "error", "error": str(error)}, ensure_ascii=False))
        return 1
    print(json.dumps({"status": "success", **result}, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())

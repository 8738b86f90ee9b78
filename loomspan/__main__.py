"""python -m loomspan TOOL FOLDER [JSON]: one tool over a folder of source code."""

import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.adapters import FolderSource
from .tools import TOOLS, Server


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in TOOLS:
        print(__doc__, "Tools:", *TOOLS)
        return 2
    spark = SparkSession.builder.getOrCreate()
    server = Server(Engine(spark, FolderSource(spark, args[1])).index())
    said = server.call(args[0], json.loads(args[2]) if len(args) > 2 else {})
    print(said if isinstance(said, str) else json.dumps(said, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

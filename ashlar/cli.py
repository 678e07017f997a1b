"""Call an operator from a shell: python -m ashlar.cli FOLDER OPERATOR [name=value ...]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.registry import OPERATORS, answer
from .session import Session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ashlar", description="Code-knowledge queries over a folder of Parquet tables.")
    parser.add_argument("folder")
    parser.add_argument("operator", choices=sorted(OPERATORS))
    parser.add_argument("arguments", nargs="*", metavar="name=value")
    options = parser.parse_args(argv)
    session = Session(SparkSession.builder.appName("ashlar").getOrCreate())
    session.load(options.folder)
    out = answer(session, options.operator, dict(a.split("=", 1) for a in options.arguments))
    json.dump(out, sys.stdout, ensure_ascii=False, default=str)
    print()
    return int("error" in out)


if __name__ == "__main__":
    sys.exit(main())

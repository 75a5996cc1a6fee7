"""Command line: ``python -m tessera.cli index FILE... FOLDER`` and ``python -m tessera.cli list FOLDER``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera.sources.catalog import Catalog
from tessera.sources.hdf5_metadata import array_metadata


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("index", "list"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args[0] == "index":
        *files, folder = args[1:]
        if not files:
            print(__doc__, file=sys.stderr)
            return 2
        Catalog.index_files(spark.createDataFrame([(f,) for f in files], "file string"), array_metadata).write(folder)
    else:
        for r in Catalog.read(spark, args[1]).datasets.orderBy("file", "group_path", "name").toLocalIterator():
            print(r["file"], f"/{r['group_path']}/{r['name']}".replace("//", "/"), list(r["shape"]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Command line: create an index, fill it from a file or a folder, search it, remove a document."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from millstone.engine import Engine, results_to_json
from millstone.sources.files import read_folder


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="millstone", description=__doc__)
    p.add_argument("-i", "--index", required=True)
    p.add_argument("-b", "--base", help="base directory; else that of the environment")
    p.add_argument("-a", "--add", action="store_true", help="create the index first")
    p.add_argument("-d", "--doc-id", type=int, help="the document of a file, or the one to remove")
    p.add_argument("-p", "--path", help="a text file (with its document id) or a folder of text files")
    p.add_argument("-s", "--search", metavar="QUERY")
    p.add_argument("-r", "--remove", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, a.base)

    def timed(what, run):
        began = time.monotonic()
        out = run()
        print(f"{what}: {round((time.monotonic() - began) * 1000)} ms")
        return out

    index = timed("creating index" if a.add else "loading index", lambda: (engine.create_index if a.add else engine.open_index)(a.index))
    if a.path:
        docs = read_folder(spark, a.path)
        if not engine.files.is_dir(a.path):
            if a.doc_id is None:
                p.error("a file needs a document id")
            docs = docs.selectExpr(f"{a.doc_id}L as doc_id", "text")
        timed("indexing", lambda: index.add_documents(docs))
    if a.remove:
        if a.doc_id is None:
            p.error("what document is to be removed?")
        timed("removing", lambda: index.remove(a.doc_id))
    if a.search:
        print(timed("search", lambda: results_to_json(index.search(a.search))))
    timed("closing index", engine.close)


if __name__ == "__main__":
    main()

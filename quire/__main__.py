"""python -m quire [--chars | --blocks] [--password X] PATH: prints one row a line."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quire.sources import pdf_source


def main(args: list[str]) -> int:
    what, password, path = "chars", None, None
    rest = iter(args)
    for a in rest:
        if a in ("--chars", "--blocks"):
            what = a[2:]
        elif a == "--password":
            password = next(rest, None)
        elif a.startswith("--password="):
            password = a.partition("=")[2]
        elif a.startswith("--"):
            print(f"unknown option {a}", file=sys.stderr)
            return 2
        else:
            path = a
    if path is None:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quire").getOrCreate()
    parsed = pdf_source.parse_pdfs(pdf_source.read_pdfs(spark, path), password).persist()
    for e in pdf_source.errors_of(parsed).toLocalIterator():
        print(f"{e.doc_id}: {e.message}", file=sys.stderr)
    rows = pdf_source.chars_of(parsed).orderBy("doc_id", "seq") if what == "chars" else pdf_source.blocks_of(parsed, False).orderBy("doc_id", "block_id")
    for r in rows.toLocalIterator():
        b = r.bbox
        print(f"{r.page_index}\t{r.ch if what == 'chars' else r.text}\t{b.top:.2f}\t{b.left:.2f}\t{b.bottom:.2f}\t{b.right:.2f}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

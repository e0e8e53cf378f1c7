"""Command line: load workbooks, build graph tables, search.

    python -m partloom.cli load FOLDER OUT
    python -m partloom.cli graph ROWS OUT
    python -m partloom.cli impact ROWS
    python -m partloom.cli search DOCUMENTS QUERY [-k N]
    python -m partloom.cli slides FOLDER OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import graph, layout, match
from partloom.session import ship
from partloom.sources import ooxml


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all sheets whose header is found: file_id, sheet, row_idx and the fields."""
    cells = ooxml.workbooks(spark, folder).where("error IS NULL").where(~layout.is_excluded_sheet(F.col("sheet")))
    labelled = layout.labelled_cells(cells, layout.alias_table(spark))
    headers = layout.header_rows(labelled)
    return layout.records(cells, headers, layout.column_map(labelled, headers), list(layout.ALIASES))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="partloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["load", "graph", "impact", "search", "slides"])
    parser.add_argument("source")
    parser.add_argument("target", nargs="?", help="a folder to write to, or what to search for")
    parser.add_argument("-k", type=int, default=10)
    args = parser.parse_args(argv)
    if args.command != "impact" and args.target is None:
        parser.error(f"{args.command} needs a second argument")
    spark = ship(SparkSession.builder.appName("partloom").getOrCreate())
    if args.command == "load":
        load(spark, args.source).write.mode("overwrite").parquet(args.target)
    elif args.command == "slides":
        ooxml.decks(spark, args.source).write.mode("overwrite").parquet(args.target)
    elif args.command == "graph":
        for name, df in graph.build(spark.read.parquet(args.source)).items():
            df.write.mode("overwrite").parquet(f"{args.target}/{name}")
    elif args.command == "impact":
        changes = graph.change_records(graph.lines(spark.read.parquet(args.source)))
        graph.impact_edges(changes).groupBy("impact_type").count().show()
    else:
        match.rerank(spark.read.parquet(args.source), args.target, args.k).show(args.k, truncate=False)


if __name__ == "__main__":
    main()

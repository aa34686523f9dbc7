"""Run both plans on a folder of tables and write the scores.

    spark-submit lagwise/plans/run.py --input <folder> --output <folder> [--format parquet]

Writes first, second and final scores of the test rows as CSV with a header.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from lagwise.plans import final, first, second
from lagwise.session import build_session, materialize
from lagwise.sources import tables


def score(
    loaded: tables.Tables,
    one: first.FirstSettings = first.FirstSettings(),
    two: second.SecondSettings = second.SecondSettings(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored (first, second, final) scores of the test rows."""
    first_scores = materialize(
        first.run(loaded, one)
        .filter("split = 'test'")
        .select("projectid", "is_exciting", "discount"),
        "first-submission",
    )
    second_scores = materialize(
        second.run(loaded, two).filter("test = 1").select("projectid", "is_exciting"),
        "second-submission",
    )
    return first_scores, second_scores, final.final_blend(first_scores, second_scores)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--tree-share", type=float, default=1.0, help="share of the full tree counts")
    parser.add_argument("--schools-file", default="schools.csv")
    parser.add_argument("--school-id-column", default="school_ncesid")
    parser.add_argument("--school-type-column", default="School.Type")
    options = parser.parse_args(arguments)

    session = spark or build_session()
    if options.format == "csv":
        loaded = tables.load_folder(
            session, options.input, {"schools": options.schools_file},
            options.school_id_column, options.school_type_column,
        )
    else:
        loaded = tables.load_parquet(session, options.input)
    scores = score(
        loaded,
        replace(first.FirstSettings(), tree_share=options.tree_share),
        replace(second.SecondSettings(), tree_share=options.tree_share),
    )
    for name, table in zip(("first", "second", "final"), scores):
        tables.write_submission(table, f"{options.output.rstrip('/')}/{name}", table.columns)


if __name__ == "__main__":
    main()

"""CSV and JSON results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(
    df: DataFrame, path: str, order: Sequence[str | Column] = (), single_file: bool = False
) -> None:
    """Header and comma. Sorted part files read in name order keep ``order``.

    ``single_file`` is for reports of bounded size; it puts all rows in one task.
    """
    if order:
        df = df.orderBy(*order)
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").options(header=True, emptyValue="").csv(path)


def series_array(df: DataFrame, order: Sequence[str | Column]) -> Column:
    """A short result as one array of records, in order, as a scalar subquery.

    For report series whose length the report itself bounds (hours, months).
    """
    record = F.struct(*[F.col(c) for c in df.columns])
    place = F.struct(
        *[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)]
    )
    pairs = F.array_sort(F.collect_list(F.struct(place.alias("place"), record.alias("record"))))
    return df.agg(F.transform(pairs, lambda p: p["record"]).alias("series")).scalar()


def json_document(
    meta: DataFrame, series: Mapping[str, tuple[DataFrame, Sequence[str | Column]]]
) -> DataFrame:
    """One row with one JSON text: the meta record and a list per series."""
    parts = [F.struct(*[F.col(c) for c in meta.columns]).alias("meta")]
    parts += [series_array(df, order).alias(name) for name, (df, order) in series.items()]
    return meta.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value"))


def write_json_document(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)

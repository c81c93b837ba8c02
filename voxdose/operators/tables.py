"""Result tables, two-decimal text, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.reports import write_named


def two_decimals(x: Column, unit: str = "", compat: bool = False, binary: bool | None = None) -> Column:
    """Text with two decimals. ``binary`` rounds the binary value half to even, as C and SQL's printf do, else the shortest decimal goes half up.

    ``compat`` is binary too, and writes what is no finite number as Python does.
    """
    text = _binary_text(x) if (compat if binary is None else binary) else F.format_string("%.2f", x)
    if compat:
        text = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(text)
    return F.when(x.isNotNull(), F.concat(text, F.lit(unit)))


def _binary_text(x: Column) -> Column:
    """Beyond 2 ** 40 by the part behind the point, which the shortest decimal cuts there; from 2 ** 63 on, digits after the seventeenth are 0."""
    size = F.abs(x)
    whole, part = F.floor(size), F.rint((size - F.floor(size)) * 100).cast("int")
    large = F.concat(F.when(x < 0, "-").otherwise(""), F.when(part < 100, whole).otherwise(whole + 1).cast("string"), F.lit("."), F.lpad((part % 100).cast("string"), 2, "0"))
    return F.when(size < 2.0**40, F.call_function("format_number", x, F.lit("0.00"))).when(size < 2.0**53, large).when(size < 2.0**63, F.concat(x.cast("bigint").cast("string"), F.lit(".00"))).otherwise(F.format_string("%.2f", x))


def last_of_name(stats: DataFrame) -> DataFrame:
    """One row per name: the place of the first segment of that name, the values of the last."""
    values = F.struct("segment_id", "dose_gy", "volume_ml", "activity_mbq")
    one = Window.partitionBy("study_id", "name")
    x = stats.select("study_id", "name", "ord", F.max_by(values, "ord").over(one).alias("v"), F.min("ord").over(one).alias("first"))
    return x.where(F.col("ord") == F.col("first")).select("study_id", "ord", "name", "v.*")


def dose_table(stats: DataFrame, lung: DataFrame | None = None, label: str = "Estimated Lung Dose") -> DataFrame:
    """Rows of the result table in order; with ``lung`` (study_id, lung_dose_gy) a first row of its own."""
    rows = last_of_name(stats).select("study_id", "ord", "name", "dose_gy", "volume_ml", "activity_mbq")
    if lung is None:
        return rows
    none = F.lit(None).cast("double")
    return lung.select("study_id", F.lit(0).alias("ord"), F.lit(label).alias("name"), F.col("lung_dose_gy").alias("dose_gy"), none.alias("volume_ml"), none.alias("activity_mbq")).unionByName(rows)


def report(table: DataFrame, heads: DataFrame, compat: bool = False, binary: bool | None = None) -> DataFrame:
    """One document per study: ``heads`` (study_id, title, stamp, parameters: array of lines) and the table's rows.

    ``compat`` ends lines of the table with a backslash and an n instead of a line feed, and writes numbers as Python does. ``binary`` is that of ``two_decimals``.
    """
    # The wording and the codes of the document.
    feed = "\\line\\n " if compat else "\\line\n"
    part = lambda c, label, unit: F.concat(F.lit(label), two_decimals(F.col(c), unit, compat, binary))
    line = F.concat(F.lit("Segment: "), F.col("name"), F.lit(", "), F.concat_ws(", ", part("dose_gy", "Dose = ", " Gy"), part("volume_ml", "Volume = ", " mL"), part("activity_mbq", "Activity = ", " MBq")), F.lit(feed))
    lines = table.groupBy("study_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    br = F.lit("\\line\n")
    head = F.concat(F.lit("{\\rtf1\\ansi\\deff0\n{\\b "), F.col("title"), F.lit("}\\line\nGenerated: "), F.col("stamp"), br, br, F.lit("{\\b Parameters}"), br, F.array_join(F.transform("parameters", lambda p: F.concat(p, br)), ""), br, F.lit("{\\b Segment Doses}"), br)
    return heads.join(lines, "study_id", "left").select("study_id", F.concat(head, F.coalesce("lines", F.lit("")), F.lit(feed + "End of Report}")).alias("report"))


def report_path(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".rtf"), name).otherwise(F.concat(name, F.lit(".rtf")))


def write_reports(reports: DataFrame, folder: str) -> None:
    """Each report (name, report) as a file of its own, named by ``report_path``: all of them, or none."""
    write_named(reports.select(report_path(F.col("name")).alias("path"), "report"), folder)

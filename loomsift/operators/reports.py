"""Reports of results: pass rates and failures as JSON lines and as one Markdown file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.formats import scratch
from ..sources.report_sink import ReportSink
from ..sources.tables import table
from .metrics import markdown_cell

FAILURES = 50


def labelled_results(spark, sf_dir) -> DataFrame:
    """id, category, passed, prompt: a result per labelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "passed", F.substring("text", 1, 40).alias("prompt"))


def report_lines(results: DataFrame) -> DataFrame:
    """section, place, line: pass rates of all categories, then the first ``FAILURES`` failures by id."""
    spark = results.sparkSession
    fixed = [
        (0, 0, "# Accuracy Report"), (0, 1, ""), (0, 2, "## Category Pass Rates"), (0, 3, ""), (0, 4, "| Category | Passed | Total | Rate |"), (0, 5, "| --- | ---: | ---: | ---: |"),
        (2, 0, ""), (2, 1, "## Failures"), (2, 2, ""), (2, 3, "| Test | Category | Prompt |"), (2, 4, "| --- | --- | --- |"),
    ]
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rates = results.groupBy("category").agg(F.count_if("passed").alias("good"), F.count(F.lit(1)).alias("total"))
    share = F.concat(F.format_string("%.1f", F.bround(F.col("good") / F.col("total") * 100, 1)), F.lit("%"))
    # Lines of a section are ordered by their place and then by themselves.
    rates = rates.select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("place"), line(markdown_cell(F.col("category")), F.col("good").cast("string"), F.col("total").cast("string"), share).alias("line"))
    failed = results.where(~F.col("passed")).orderBy("id").limit(FAILURES)
    failed = failed.select(F.lit(3).alias("section"), F.col("id").alias("place"), line(F.col("id").cast("string"), markdown_cell(F.col("category")), markdown_cell(F.col("prompt"))).alias("line"))
    return spark.createDataFrame(fixed, "section int, place long, line string").unionByName(rates).unionByName(failed)


def write_report(df: DataFrame, path: str, kind: str) -> None:
    df.sparkSession.dataSource.register(ReportSink)
    df.write.format("report").option("path", path).option("kind", kind).mode("append").save()


@query(
    "SELECT doc_id AS id, source AS category, quality = 1 AS passed, left(text, 40) AS prompt FROM documents JOIN labels USING (doc_id)"
)
def s16_json_results(spark, sf_dir):
    """Results written as JSON lines by the report sink, and read again."""
    path = scratch(spark, "results")
    write_report(labelled_results(spark, sf_dir), path, "json")
    return spark.read.schema("id long, category string, passed boolean, prompt string").json(path)


_CELL = "replace(replace({}, '|', chr(92) || '|'), chr(10), '<br>')"


@query(
    "WITH r AS (SELECT doc_id, source, quality = 1 AS passed, left(text, 40) AS prompt FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count(*) FILTER (passed) AS good, count(*) AS total FROM r GROUP BY source), "
    "l AS (SELECT unnest(['# Accuracy Report', '', '## Category Pass Rates', '', '| Category | Passed | Total | Rate |', '| --- | ---: | ---: | ---: |', '', '## Failures', '', '| Test | Category | Prompt |', '| --- | --- | --- |']) AS line, unnest([0, 0, 0, 0, 0, 0, 2, 2, 2, 2, 2]) AS section, unnest(range(11)) AS place "
    f"UNION ALL SELECT '| ' || {_CELL.format('source')} || ' | ' || good || ' | ' || total || ' | ' || format('{{:.1f}}', round_even(good / total * 100, 1)) || '% |', 1, 0 FROM c "
    f"UNION ALL SELECT * FROM (SELECT '| ' || doc_id || ' | ' || {_CELL.format('source')} || ' | ' || {_CELL.format('prompt')} || ' |', 3, doc_id FROM r WHERE NOT passed ORDER BY doc_id LIMIT {FAILURES})) "
    "SELECT row_number() OVER (ORDER BY section, place, line) AS n, line FROM l"
)
def s16_markdown_report(spark, sf_dir):
    """The Markdown report, one file that the sink's commit puts together, line by line."""
    path = scratch(spark, "report")
    write_report(report_lines(labelled_results(spark, sf_dir)), path, "markdown")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("n", "line"))
    return lines.select((F.col("n") + 1).cast("long").alias("n"), "line")

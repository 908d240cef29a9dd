"""Monitoring of assistants: requests to platforms, results, run summaries, alerts and the history of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import render
from quarry.operators.mentions import cited_url, parse_chatgpt, parse_google, parse_perplexity
from quarry.sources.shared import exists

#: Platform, source name of its requests, shown name, longest prompt.
PLATFORMS = [("perplexity", "perplexity", "Perplexity", 10000), ("chatgpt", "chatgpt", "ChatGPT", 4000), ("google", "google_ai_mode", "Google AI Mode", 400)]
NAMES = {p[0]: p[2] for p in PLATFORMS}
RESULT = "entity string, entityName string, prompt string, timestamp string, platform string, cited boolean, citedUrl string, sources array<struct<title:string,url:string>>, answerExcerpt string"
#: Runs that the history shows; sources and characters that a result keeps.
HISTORY, SOURCES, EXCERPT = 10, 10, 500


def question(name: Column) -> Column:
    return F.concat(F.lit("What is "), name, F.lit("?"))


def platform_requests(prompts: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """prompts (prompt and other columns) with platform and payload: a JSON request whose prompt is cut to the platform's length."""
    chosen = [p for p in PLATFORMS if platforms is None or p[0] in platforms]
    cut, place = lambda n: F.left("prompt", F.lit(n)), F.lit("United States").alias("geo_location")
    made = []
    for key, source, _, longest in chosen:
        head = [F.lit(source).alias("source"), cut(longest).alias("query" if key == "google" else "prompt"), place]
        more = [F.lit("html").alias("render")] if key == "google" else []
        made.append(F.struct(F.lit(key).alias("platform"), F.to_json(F.struct(*head, *more, F.lit(True).alias("parse"))).alias("payload")))
    return prompts.select("*", F.explode(F.array(*made)).alias("request")).select(*prompts.columns, "request.*")


def platform_answers(requests: DataFrame, recording: DataFrame) -> DataFrame:
    """requests with the recorded answer and sources of recording (platform, prompt, status, content).

    A request without a recording, or with a status other than 200 or no content, has no row, as one that fails.
    """
    found = requests.join(recording.where("status = 200 AND content IS NOT NULL"), ["platform", "prompt"])
    parsed = F.when(F.col("platform") == "perplexity", parse_perplexity(F.col("content"))).when(F.col("platform") == "chatgpt", parse_chatgpt(F.col("content"))).otherwise(parse_google(F.col("content")))
    return found.withColumn("parsed", parsed).select(*requests.columns, "parsed.answer", "parsed.sources")


def mention_results(answers: DataFrame, site: str, at: Column) -> DataFrame:
    """answers (entity, entityName, prompt, platform, answer, sources) as results of a run at the time `at` (ISO text)."""
    cited = cited_url(F.col("sources"), site)
    return answers.select(
        "entity", "entityName", "prompt", at.alias("timestamp"), "platform", cited.isNotNull().alias("cited"), cited.alias("citedUrl"),
        F.slice("sources", 1, SOURCES).alias("sources"), F.left("answer", F.lit(EXCERPT)).alias("answerExcerpt"),
    )


def platform_breakdown(results: DataFrame) -> DataFrame:
    return results.groupBy("platform").agg(F.count(F.lit(1)).alias("checked"), F.count_if("cited").alias("cited"))


def run_summary(results: DataFrame, at: Column) -> DataFrame:
    """One row: lastRun, totalChecks, citations, platformBreakdown (a map of a platform's checked and cited)."""
    per = platform_breakdown(results)
    breakdown = F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", F.struct("checked", "cited")))))
    zero = F.lit(0).cast("long")
    return per.agg(F.coalesce(F.sum("checked"), zero).alias("totalChecks"), F.coalesce(F.sum("cited"), zero).alias("citations"), breakdown.alias("platformBreakdown")).select(at.alias("lastRun"), "*")


def save_run(spark: SparkSession, folder: str, results: DataFrame, at: str) -> None:
    """Appends a run's results below its time and replaces the latest summary and results. Running it again replaces the same run."""
    token = at.replace(":", "-").replace(".", "-")
    results.write.mode("overwrite").parquet(f"{folder}/runs/{token}")
    run_summary(results, F.lit(at)).write.mode("overwrite").parquet(f"{folder}/latest/summary")
    results.write.mode("overwrite").parquet(f"{folder}/latest/results")


def latest_run(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest summary; None where there is none."""
    return spark.read.parquet(f"{folder}/latest/summary") if exists(spark, f"{folder}/latest/summary") else None


def run_names(spark: SparkSession, folder: str, newest: int | None = None) -> list[str]:
    """Names of the runs, newest first, from the folder alone."""
    if not exists(spark, f"{folder}/runs"):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs")
    found = sorted((s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)), reverse=True)
    return [n for n in found if not n.startswith((".", "_"))][:newest]


def mention_history(spark: SparkSession, folder: str, newest: int = HISTORY) -> DataFrame:
    """lastRun, totalChecks, citations, results (their number) of the newest runs. Counts are 0 and all dashes of the name are colons, as readers of the history expect."""
    names = run_names(spark, folder, newest)
    if not names:
        return spark.createDataFrame([], "lastRun string, totalChecks long, citations long, results long")
    rows = spark.read.schema(RESULT).parquet(*[f"{folder}/runs/{n}" for n in names])
    per = rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("results"))
    zero = F.lit(0).cast("long")
    listed = spark.createDataFrame([(n,) for n in names], "run string").join(per, "run", "left")
    return listed.select(F.translate("run", "-", ":").alias("lastRun"), zero.alias("totalChecks"), zero.alias("citations"), F.coalesce("results", zero).alias("results"))


def _text(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def citation_alerts(results: DataFrame, site: str) -> DataFrame:
    """entity, platform, payload: a message for each cited result. Nothing is sent from here."""
    name = F.coalesce(render.choose(F.col("platform"), NAMES, F.col("platform")), F.lit(""))
    field = lambda label, value: _text("mrkdwn", F.concat(F.lit(f"*{label}:*\n"), value))
    fields = F.array(
        field("Entity", F.col("entityName")), field("Platform", name), field("Citation URL", F.coalesce(F.nullif("citedUrl", F.lit("")), F.lit("N/A"))),
        field("Timestamp", render.rfc_date(F.to_timestamp("timestamp"))),
    )
    excerpt = _text("mrkdwn", F.concat(F.lit("*Answer Excerpt:*\n>"), F.left("answerExcerpt", F.lit(200)), F.lit("...")))
    text = F.concat(F.lit(f"Citation Found! {site} was cited by "), name, F.lit(" for "), F.col("entityName"))
    payload = F.to_json(F.struct(text.alias("text"), _text("plain_text", F.lit(f"{site} Cited!")).alias("header"), fields.alias("fields"), excerpt.alias("section")))
    return results.where("cited").select("entity", "platform", payload.alias("payload"))


def summary_alert(summary: DataFrame) -> DataFrame:
    """text, status, platforms of a run's summary; no row for a run without checks."""
    shown = F.transform(F.array_sort(F.map_entries("platformBreakdown")), lambda e: F.concat(render.choose(e["key"], NAMES, e["key"]), F.lit(": "), e["value"]["cited"].cast("string"), F.lit("/"), e["value"]["checked"].cast("string")))
    text = F.concat(F.lit("AI Monitoring Complete: "), F.col("citations").cast("string"), F.lit("/"), F.col("totalChecks").cast("string"), F.lit(" citations"))
    status = F.when(F.col("citations") > 0, "Citations Found!").otherwise("No Citations Yet")
    return summary.where("totalChecks > 0").select(text.alias("text"), status.alias("status"), F.array_join(shown, " | ").alias("platforms"))

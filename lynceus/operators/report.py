"""Traces of scoring and their summaries, as tables; texts and the HTML page at the very end."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phases of the life of a score.
PHASES = ["NORMALIZATION", "TOKENIZATION", "PHONETIC_FILTER", "NAME_COMPARISON", "ALT_NAME_COMPARISON", "GOV_ID_COMPARISON", "CRYPTO_COMPARISON", "CONTACT_COMPARISON", "ADDRESS_COMPARISON", "DATE_COMPARISON", "AGGREGATION", "FILTERING"]
# Parts of a breakdown and their names in explanations.
PARTS = {"name": "Primary name match", "alt_names": "Alternative names", "address": "Address match", "gov_id": "Government ID", "crypto": "Cryptocurrency", "contact": "Contact info", "date": "Date of birth"}


def percent(c: Column) -> Column:
    """Whole percents, cut off."""
    return (c * 100).cast("int").cast("string")


def explained(b: Column) -> Column:
    """A breakdown in words."""
    parts = F.array_compact(F.array(*[F.when(b[k] > 0, F.concat(F.lit(f"{v}: "), percent(b[k]), F.lit("%"))) for k, v in PARTS.items()]))
    text = F.concat(F.lit("Score factors: "), F.array_join(parts, ", "), F.lit(". Final weighted score: "), percent(b["total"]), F.lit("%"))
    return F.when(b.isNull(), "No score breakdown available").when(F.size(parts) == 0, "No significant matches found").otherwise(text)


def short_explained(b: Column) -> Column:
    """A breakdown in one line, headed by its quality."""
    names = {"name": "Name", "alt_names": "Alt Names", "address": "Address", "gov_id": "Gov ID"}
    parts = F.array_compact(F.array(*[F.when(b[k] > 0, F.concat(F.lit(f"{v} "), percent(b[k]), F.lit("%"))) for k, v in names.items()]))
    none = F.concat(quality(b["total"]), F.lit(" match ("), F.format_string("%.0f", b["total"] * 100), F.lit("%)"))
    return F.when(b.isNull(), "No scoring data available").when(F.size(parts) == 0, none).otherwise(F.concat(quality(b["total"]), F.lit(" match: "), F.array_join(parts, ", ")))


def debug_text(query: Column, index: Column, b: Column) -> Column:
    """The scores of a pair, one a line."""
    head = F.format_string("=== Debug Similarity ===\nQuery: %s (%s)\nIndex: %s (%s)\n\nScore Components:\n", query["name"], query["entity_type"], index["name"], index["entity_type"])
    lines = {"Name Score:": "name", "Alt Names:": "alt_names", "Gov ID Score:": "gov_id", "Crypto Score:": "crypto", "Address Score:": "address", "Contact Score:": "contact", "Date Score:": "date"}
    body = F.concat(*[F.format_string(f"  {k:<18}%.4f\n", b[v]) for k, v in lines.items()])
    return F.concat(head, body, F.format_string("\nFinal Score: %.4f\nMatch: %s (threshold 0.5)\n\n", b["total"], b["total"] > 0.5))


def report_summary(events: DataFrame, breakdowns: DataFrame) -> DataFrame:
    """Per session: entities scored, the last breakdown's total as average, highest and lowest score, contributions above nought, time by phase.

    events: (session_id, phase, duration_ms); breakdowns: (session_id, breakdown), one row a session.
    """
    times = events.groupBy("session_id", "phase").agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n"))
    per = times.groupBy("session_id").agg(
        F.sum(F.when(F.col("phase") == "AGGREGATION", F.col("n")).otherwise(0)).alias("entities_scored"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "ms")))).alias("phase_ms"), F.max_by("phase", F.struct("ms", "phase")).alias("slowest_phase"),
    )
    b = F.col("breakdown")
    total = F.coalesce(b["total"], F.lit(0.0))
    shares = F.map_filter(F.create_map(*[x for k in PARTS for x in (F.lit(k), b[k])]), lambda _, v: v > 0)
    return per.join(breakdowns, "session_id", "left").select("session_id", "entities_scored", total.alias("average_score"), total.alias("highest_score"), total.alias("lowest_score"), shares.alias("contributions"), "phase_ms", "slowest_phase")


def insights(b: Column, duration_ms: Column) -> Column:
    """What stands out in a breakdown, as a list of sentences."""
    strong = sum((F.when(b[k] > 0.85, 1).otherwise(0) for k in ("name", "alt_names", "address", "gov_id")), F.lit(0))
    alone = (b["name"] > 0.8) & (b["alt_names"] == 0) & (b["address"] == 0) & (b["gov_id"] == 0)
    return F.array_compact(
        F.array(
            F.when((b["name"] > 0.9) & (b["total"] < 0.85), "Strong name match, but limited supporting evidence from other fields"),
            F.when(strong >= 3, "High confidence match with multiple strong indicators"),
            F.when(alone, "Match based solely on name similarity - consider requesting additional identifying information"),
            F.when(duration_ms > 100, F.concat(F.lit("Processing took longer than usual ("), duration_ms.cast("string"), F.lit("ms) - consider optimizing or reviewing data quality"))),
        )
    )


def quality(score: Column) -> Column:
    return F.when(score >= 0.9, "Strong").when(score >= 0.75, "Good").when(score >= 0.6, "Moderate").otherwise("Weak")


def band(score: Column) -> Column:
    return F.when(score >= 0.9, "very high").when(score >= 0.7, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("very low")


def phase_counts(events: DataFrame, most: int = 3) -> DataFrame:
    """The phases with most events of each session, ties by name."""
    from pyspark.sql import Window

    n = events.groupBy("session_id", "phase").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("n").desc(), "phase"))).where(F.col("rank") <= most)


def trace_summary(events: DataFrame) -> DataFrame:
    """Per session: entities scored, the slowest phase on average if it takes more than 10 ms, and time in all."""
    per = events.groupBy("session_id", "phase").agg(F.count("*").alias("n"), F.floor(F.avg("duration_ms")).alias("mean_ms"), F.sum("duration_ms").alias("total_ms"))
    slow = F.max_by("phase", F.struct("mean_ms", "phase"))
    return per.groupBy("session_id").agg(
        F.sum(F.when(F.col("phase") == "AGGREGATION", F.col("n")).otherwise(0)).alias("entities_scored"),
        F.when(F.max("mean_ms") > 10, slow).alias("slowest_phase"), F.sum("total_ms").alias("total_ms"), F.max_by("phase", F.struct("total_ms", "phase")).alias("longest_phase"),
    )


class Traces:
    """Append-only store of traces by session."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def put(self, more: DataFrame) -> None:
        self.table = self.table.unionByName(more)

    def get(self, session_id: str) -> DataFrame:
        return self.table.where(F.col("session_id") == session_id)

    def delete(self, session_id: str) -> None:
        self.table = self.table.where(F.col("session_id") != session_id)


# What scores are called in reports, from the least score on that each is for.
NAME_TEXTS = [
    (0.9, "Very strong name match - names are nearly identical"), (0.7, "Strong name match - names are very similar"), (0.5, "Moderate name match - names share significant similarities"),
    (0.3, "Weak name match - some similarities but notable differences"), (None, "Very weak name match - names are quite different"),
]
TOTAL_TEXTS = [
    (0.9, "HIGH RISK - Very strong match, likely the same entity"), (0.7, "MEDIUM RISK - Strong match, requires manual review"), (0.5, "MEDIUM RISK - Moderate match, further investigation recommended"), (None, "LOW RISK - Weak match, likely a false positive"),
]
# What each phase does.
PHASE_TEXTS = {
    "NORMALIZATION": "Standardize text (remove accents, lowercase, punctuation) for consistent comparison", "TOKENIZATION": "Break names into words and generate combinations for matching",
    "PHONETIC_FILTER": "Use sound-alike matching (Soundex) to catch spelling variations", "NAME_COMPARISON": "Compare primary names using similarity algorithm (Jaro-Winkler)",
    "ALT_NAME_COMPARISON": "Check against known aliases and alternate spellings", "GOV_ID_COMPARISON": "Match government IDs (passport, tax ID) for exact identification", "CRYPTO_COMPARISON": "Compare cryptocurrency wallet addresses",
    "CONTACT_COMPARISON": "Match email addresses, phone numbers, and fax numbers", "ADDRESS_COMPARISON": "Compare physical addresses and locations", "DATE_COMPARISON": "Compare birth dates, death dates, and other temporal data",
    "AGGREGATION": "Combine all component scores into final weighted score", "FILTERING": "Apply minimum match threshold to filter out low-confidence results",
}


def _banded(texts: list, score: Column) -> Column:
    out = None
    for least, text in texts[:-1]:
        out = F.when(score >= least, text) if out is None else out.when(score >= least, text)
    return out.otherwise(texts[-1][1])


def name_text(score: Column) -> Column:
    return _banded(NAME_TEXTS, score)


def total_text(score: Column) -> Column:
    return _banded(TOTAL_TEXTS, score)


def _of(texts: list, score: float) -> str:
    return next(t for least, t in texts if least is None or score >= least)


def html_page(summary: dict, contributions: dict[str, float], phases: list[dict], metadata: dict | None = None) -> str:
    """One page of a session: an executive summary with the total in words, the breakdown, the phases and what they do, metadata. Every text is
    escaped; a session without events has a page that says so."""
    e = lambda x: html.escape(str(x))
    if not phases and not contributions:
        return "<!doctype html><html><head><meta charset='utf-8'><title>Empty report</title></head><body><h1>No trace data available</h1></body></html>"
    kind = lambda s: "high" if s >= 0.7 else "medium" if s >= 0.3 else "low"
    row = lambda *cells: "<tr>" + "".join(f"<td>{e(c)}</td>" for c in cells) + "</tr>"
    said = "".join(f"<p class='{kind(float(summary[k]))}'>{e(text)}</p>" for k, text in [(k, _of(TOTAL_TEXTS, float(summary[k]))) for k in ("average_score",) if summary.get(k) is not None])
    facts = "".join(row(k, v) for k, v in summary.items())
    scores = "".join(f'<tr class="{kind(v)}"><td>{e(PARTS.get(k, k))}</td><td>{v:.3f}</td><td>{e(_of(NAME_TEXTS, v)) if k == "name" else ""}</td></tr>' for k, v in contributions.items())
    times = "".join(row(k + 1, p["phase"], p["n"], p["total_ms"], PHASE_TEXTS.get(p["phase"], "")) for k, p in enumerate(phases))
    more = "<h2>Metadata</h2><table>" + "".join(row(k, v) for k, v in metadata.items()) + "</table>" if metadata else ""
    return (
        "<!doctype html><html lang='en'><head><meta charset='utf-8'><title>Scoring report</title></head><body><h1>Scoring report</h1>"
        f"<h2>Executive summary</h2>{said}<table>{facts}</table><h2>Breakdown</h2><table>{scores}</table><h2>Phases</h2><table>{times}</table>{more}</body></html>"
    )


def search_hits(results: DataFrame, traced: bool = False) -> DataFrame:
    """Rows of a search as an interface returns them; the breakdown only if the search was traced."""
    columns = ["id", "name", "entity_type", "source", "source_id", "score", "alt_names", F.col("sanctions.programs").alias("programs")]
    return results.select(*columns, *(["breakdown"] if traced else []))


def as_json(hits: DataFrame, request_id: str, debug: str | None = None, trace_id: str | None = None) -> DataFrame:
    """One JSON text: results, their number and the request's id, with a debug text and a trace's id and report address where they are given.
    Results are at most a search's limit."""
    more = [F.lit(debug).alias("debug")] if debug else []
    more += [F.lit(trace_id).alias("trace"), F.lit(f"/api/reports/{trace_id}").alias("reportUrl")] if trace_id else []
    body = F.struct(F.collect_list(F.struct(*hits.columns)).alias("results"), F.count("*").alias("total"), F.lit(request_id).alias("requestID"), *more)
    return hits.agg(F.to_json(body).alias("response"))

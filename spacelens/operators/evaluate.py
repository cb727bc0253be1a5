"""Golden-case checks of an answers table and the summary rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spacelens.operators.ranking import counts_below


def check_cases(cases: DataFrame) -> DataFrame:
    """One verdict per case.

    Columns: case_id, answer, refused, expect_refusal, tools_called, required_tools,
    must_include, must_not_include (arrays), min_length, grounded (nullable),
    invalid_citations (array), latency_ms.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    length = F.length(F.coalesce("answer", F.lit("")))
    # Bound once per row: the answer is folded to lower case once, not per word.
    found = F.transform(
        F.array(answer),
        lambda a: F.struct(
            F.filter("must_include", lambda w: ~F.contains(a, F.lower(w))).alias("missing"),
            F.filter("must_not_include", lambda w: F.contains(a, F.lower(w))).alias("forbidden"),
        ),
    ).getItem(0)
    parts = cases.withColumns(
        {
            "missing_tools": F.filter(
                "required_tools", lambda t: ~F.array_contains(F.col("tools_called"), t)
            ),
            "_found": found,
            "answer_length": length,
        }
    ).withColumns(
        {"missing_content": F.col("_found.missing"), "forbidden_content": F.col("_found.forbidden")}
    )

    def listed(prefix: str, column: str):
        return F.when(
            F.size(column) > 0, F.concat(F.lit(prefix), F.array_join(column, ", "))
        )

    checks = F.array_compact(
        F.array(
            F.when(F.col("refused"), "refused"),
            listed("tools: ", "missing_tools"),
            listed("omits: ", "missing_content"),
            listed("forbidden: ", "forbidden_content"),
            F.when(
                F.col("answer_length") < F.col("min_length"),
                F.concat(
                    F.lit("short: "), F.col("answer_length").cast("string"),
                    F.lit(" < "), F.col("min_length").cast("string"),
                ),
            ),
            F.when(~F.coalesce("grounded", F.lit(True)), "ungrounded"),
            listed("citations: ", "invalid_citations"),
        )
    )
    refusal = F.when(
        F.col("refused"), F.array().cast("array<string>")
    ).otherwise(F.array(F.lit("answered")))
    expected = F.col("expect_refusal")
    none = F.array().cast("array<string>")

    def unless_refusal(column: str):
        return F.when(expected, none).otherwise(F.col(column))

    reasons = F.when(expected, refusal).otherwise(checks)
    return parts.select(
        "case_id",
        (F.size(reasons) == 0).alias("passed"),
        F.when(expected, F.lit(None).cast("boolean")).otherwise(F.col("grounded")).alias("grounded"),
        unless_refusal("missing_tools").alias("missing_tools"),
        unless_refusal("missing_content").alias("missing_content"),
        unless_refusal("forbidden_content").alias("forbidden_content"),
        unless_refusal("invalid_citations").alias("invalid_citations"),
        "refused",
        F.col("expect_refusal").alias("expected_refusal"),
        "answer_length",
        "latency_ms",
        reasons.alias("failure_reasons"),
    )


def summarise(results: DataFrame) -> DataFrame:
    """One row of rates and latency quantiles; a rate over nothing keeps its default."""
    relevant = ~F.col("expected_refusal")

    def rate(ok, base):
        return F.avg(F.when(base, ok.cast("double")))

    rates = results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("passed").alias("passed"),
        F.coalesce(rate(F.col("passed"), F.lit(True)), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(rate(F.col("grounded"), relevant & F.col("grounded").isNotNull()), F.lit(1.0))
        .alias("groundedness"),
        F.coalesce(rate(F.size("missing_tools") == 0, relevant), F.lit(1.0)).alias("tool_recall"),
        F.coalesce(rate(F.size("invalid_citations") == 0, relevant), F.lit(1.0))
        .alias("citation_validity"),
        F.coalesce(rate(F.size("missing_content") == 0, relevant), F.lit(1.0))
        .alias("content_coverage"),
        F.coalesce(rate(F.col("refused") == F.col("expected_refusal"), F.lit(True)), F.lit(0.0))
        .alias("refusal_accuracy"),
    )
    timed = results.where("latency_ms > 0").select(
        F.lit(1).alias("all"), F.col("latency_ms").cast("double").alias("ms")
    )
    counted = counts_below(timed, ["all"], "ms")
    last = F.col("total") - 1
    positions = {
        "lo": F.floor(last / 2), "hi": F.ceil(last / 2),
        "p95": F.least(last, F.bround(last * 0.95, 0).cast("long")),
    }
    here = {
        name: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col("ms")))
        for name, p in positions.items()
    }
    latency = counted.agg(*[c.alias(name) for name, c in here.items()])
    middle = latency.select((F.col("lo") + F.col("hi")) / 2).scalar()
    return rates.select(
        "*",
        F.coalesce(middle, F.lit(0.0)).alias("median_latency_ms"),
        F.coalesce(latency.select("p95").scalar(), F.lit(0.0)).alias("p95_latency_ms"),
    )

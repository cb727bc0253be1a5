"""Batch checks of written answers: numbers against evidence, citations, named spaces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spacelens.config import VerifyConfig
from spacelens.functions import verify_text as vt
from spacelens.operators.substring import substring_join
from spacelens.sources.stage import stage


def evidence_numbers(
    evidence: DataFrame, key: str = "evidence_key", text: str = "text",
    number: str | None = None, ratio_forms: bool = True,
) -> DataFrame:
    """Distinct (key, value): numbers inside texts, numeric cells also x100 and /100."""
    parts = [evidence.select(key, F.explode(vt.numbers(F.col(text))).alias("value"))]
    if number is not None:
        v = F.col(number).cast("double")
        forms = [v, F.round(v * 100.0, 6), F.round(v / 100.0, 6)] if ratio_forms else [v]
        cells = evidence.where(F.col(number).isNotNull())
        parts.append(cells.select(key, F.explode(F.array(*forms)).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def numeric_claims(
    answers: DataFrame, keys: list[str], text: str = "text", config: VerifyConfig = VerifyConfig()
) -> DataFrame:
    """(keys, claim_no, claim): one row per factual number, in reading order."""
    return answers.select(
        *keys, F.posexplode(vt.claims(F.col(text), config.ignore_below)).alias("claim_no", "claim")
    )


def _bucket(value, width: float):
    return F.floor(F.log(value) / F.lit(width)).cast("long")


def ungrounded_claims(
    claims: DataFrame, evidence: DataFrame, config: VerifyConfig = VerifyConfig()
) -> DataFrame:
    """Claims with no evidence of the same key within the tolerance window.

    ``claims`` holds (evidence_key, claim, ...), ``evidence`` distinct (evidence_key, value).
    Evidence is reduced to the smallest and largest value of each logarithmic bucket. A bucket
    is narrower than any window, so a window never lies strictly inside one bucket: whether a
    bucket reaches into the window shows in its two extremes alone. A claim therefore meets at
    most a handful of rows, however much evidence there is.
    """
    width = math.log1p(config.tolerance) / 2
    if config.absolute_window > config.tolerance * config.ignore_below:
        raise ValueError("the absolute window must not dominate at the smallest checked claim")
    target = F.abs("claim")
    # Values that no window can reach (claims below the floor are not checked) drop out early.
    floor = config.ignore_below * (1 - config.tolerance) / 2
    sized = evidence.select("evidence_key", F.abs("value").alias("v")).where(F.col("v") > floor)
    extremes = sized.groupBy("evidence_key", _bucket(F.col("v"), width).alias("bucket")).agg(
        F.min("v").alias("low"), F.max("v").alias("high")
    )
    distinct = claims.select("evidence_key", target.alias("target")).distinct()
    lo = F.col("target") - F.greatest(config.tolerance * F.col("target"), F.lit(config.absolute_window))
    hi = F.col("target") + F.greatest(config.tolerance * F.col("target"), F.lit(config.absolute_window))
    # One more bucket on both sides absorbs rounding in the logarithm.
    spread = distinct.withColumn(
        "bucket", F.explode(F.sequence(_bucket(lo, width) - 1, _bucket(hi, width) + 1))
    )

    def near(c: str):
        return F.abs(F.col(c) - F.col("target")) <= F.greatest(
            config.tolerance * F.col("target"), F.lit(config.absolute_window)
        )

    grounded = (
        spread.join(extremes, ["evidence_key", "bucket"])
        .where(near("low") | near("high"))
        .select("evidence_key", "target")
        .distinct()
    )
    return (
        claims.withColumn("target", target)
        .join(grounded, ["evidence_key", "target"], "left_anti")
        .drop("target")
    )


def grounding_report(
    answers: DataFrame, evidence: DataFrame, key: str = "answer_id",
    config: VerifyConfig = VerifyConfig(),
) -> DataFrame:
    """Per answer: passed, numbers checked, and the ungrounded ones in reading order.

    ``answers`` holds (key, evidence_key, text); ``evidence`` distinct (evidence_key, value).
    The texts are read once: their numbers are written out, and both sides start from those.
    """
    found = vt.claims(F.col("text"), config.ignore_below)
    read = stage(answers.select(key, "evidence_key", found.alias("claims")), "claims")
    claims = read.select(
        key, "evidence_key", F.posexplode("claims").alias("claim_no", "claim")
    )
    missing = ungrounded_claims(claims, evidence, config).groupBy(key).agg(
        # The list of one answer's own numbers.
        F.array_sort(F.collect_list(F.struct("claim_no", "claim"))).alias("m")
    )
    return read.join(missing, key, "left").select(
        key,
        F.col("m").isNull().alias("passed"),
        F.size("claims").alias("checked"),
        F.coalesce(F.col("m.claim"), F.array().cast("array<double>")).alias("ungrounded"),
    )


def citation_report(answers: DataFrame, known_ids: DataFrame, key: str = "answer_id") -> DataFrame:
    """Per answer: cited ids, ids that do not exist (invalid), claims without a citation (warned)."""
    parts = stage(
        answers.select(
            key,
            vt.cited_ids(F.col("text")).alias("cited"),
            vt.uncited_claims(F.col("text")).alias("uncited"),
        ),
        "citations",
    )
    known = known_ids.select(F.upper("id").alias("cite")).distinct()
    unknown = (
        parts.select(key, F.explode("cited").alias("cite"))
        .join(known, "cite", "left_anti")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("cite")).alias("unknown"))
    )
    return parts.join(unknown, key, "left").select(
        key,
        F.col("unknown").isNull().alias("valid"),
        "cited",
        F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"),
        "uncited",
    )


def guard_verdict(grounding: DataFrame, citations: DataFrame, key: str = "answer_id") -> DataFrame:
    """Passed when numbers are grounded and citations exist; uncited claims only warn."""
    joined = grounding.join(citations, key)
    n = F.size("uncited")
    return joined.select(
        key,
        (F.col("passed") & F.col("valid")).alias("passed"),
        F.col("passed").alias("grounded"),
        F.col("valid").alias("citations_valid"),
        "checked",
        F.size("ungrounded").alias("ungrounded_count"),
        F.size("unknown").alias("unknown_count"),
        n.alias("uncited_count"),
        F.when(
            n > 0,
            F.concat(n.cast("string"), F.lit(" sentence(s) make an external claim without a citation.")),
        ).otherwise("").alias("warning"),
    )


def mentioned_spaces(
    questions: DataFrame, spaces: DataFrame, key: str = "question_id", limit: int = 3
) -> DataFrame:
    """Spaces whose label holds most of the question's longer words, larger spaces first.

    Only words that occur in a label matter, and questions with the same such words have the
    same answer: it is worked out once per distinct word list, however many questions share it.
    """
    words = F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-]{4,}"), F.lit(0)
    )
    each = F.array_distinct(F.transform(words, F.upper))
    asked = questions.select(key, F.explode(each).alias("word"))
    labels = spaces.select("level", "space_id", "value_t2", F.upper("space_label").alias("label"))
    found = stage(substring_join(labels, "label", asked, "word"), "label_words")
    known = asked.join(found.select("word").distinct(), "word", "left_semi")
    # At most the words of one question.
    lists = known.groupBy(key).agg(F.array_sort(F.collect_list("word")).alias("words"))
    lists = stage(lists, "question_words")
    # Labels with the same asked words score alike but for their spaces' values, so a word that
    # most labels hold meets word sets, each with its largest few spaces, and not the spaces.
    held = found.groupBy("label").agg(F.array_sort(F.collect_list("word")).alias("held"))
    of_set = Window.partitionBy("held").orderBy(
        F.desc(F.round("value_t2", 6)), F.desc("space_id"), "level"
    )
    largest = (
        labels.join(held, "label")
        .withColumn("_n", F.row_number().over(of_set))
        .where(F.col("_n") <= limit)
        .select("held", "level", "space_id", "value_t2")
    )
    sets = held.select("held").distinct().select("held", F.explode("held").alias("word"))
    shared = (
        lists.select("words").distinct()
        .select("words", F.explode("words").alias("word"))
        .join(sets, "word")
        .groupBy("words", "held")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scored = shared.join(largest, "held").select(
        "words", "level", "space_id", F.round(F.col("n") * 1000.0 + F.col("value_t2"), 6).alias("score")
    )
    order = Window.partitionBy("words").orderBy(F.desc("score"), F.desc("space_id"), "level")
    best = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return lists.join(best, "words").drop("words")

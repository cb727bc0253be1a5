"""Quality rules with thresholds that follow each language and source.

Fixed cutoffs reject whole sources that merely look unlike the rest. Here every (language,
source) has a sketch of each measure; a document is rejected when it lies far outside what is
usual for its own group. A sketch is a histogram over logarithmic buckets: counts add up, so
sketches merge exactly in any order, a source's sketch merges into its language's, and a
quantile read from it is within ``ALPHA`` of the true value.

Defined cases: a null text has no words and fails the base rule; null language or source is a
group of its own; a group with fewer than ``min_docs`` documents uses its language's thresholds,
and a language with fewer those of all documents; repeated rows are judged one by one alike; an
empty table gives an empty result. Input columns of any name are kept; the operator's own come
back in the struct ``quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spacelens.llm.words import WORD, packed, word_array

#: Relative error of a quantile; the bucket base that gives it.
ALPHA = 0.02
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Smaller values share bucket 0.
SMALLEST = 1e-4
WINDOW = 8
UPPER = "A-Z"
LETTERS = "A-Za-z"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RuleConfig:
    """min_words, most_repeated: the base rule. spread: how many times the distance between the
    median and the lower quartile a value may lie from the median, besides the measure's own
    allowance (``slack``). min_docs: least documents of a group with thresholds of its own.
    """

    min_words: int = 20
    most_repeated: int = 30
    spread: float = 6.0
    min_docs: int = 200
    symbol_slack: float = 0.25
    upper_slack: float = 0.25
    line_slack: float = 0.6
    length_slack: float = 1.5
    echo_slack: float = 0.3

    def slacks(self) -> dict[str, float]:
        return {
            "symbols": self.symbol_slack,
            "upper": self.upper_slack,
            "lines": self.line_slack,
            "length": self.length_slack,
            "echo": self.echo_slack,
        }


def _among(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are of this class of ASCII characters.

    The stretches of others are cut out; ``translate`` would make a string of every character.
    """
    return F.octet_length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _cheap(df: DataFrame, text: Column) -> DataFrame:
    """The counts and the five measures that are sketched: symbols and characters a word, the
    shares of upper-case letters, of lines seen before and of words that echo the word before.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumns({"_words": word_array(text), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _among(text, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines"),
            "n_upper": _among(text, UPPER),
            "n_letters": _among(text, LETTERS),
            "n_echo": F.size(
                F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1)))
            ),
        }
    )
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    return df.withColumn(
        "measures",
        F.struct(
            (F.col("n_symbols") / least("n_words")).alias("symbols"),
            (F.col("n_upper") / least("n_letters")).alias("upper"),
            (F.col("n_dup_lines") / least("n_lines")).alias("lines"),
            (F.col("word_chars") / least("n_words")).alias("length"),
            (F.col("n_echo") / least("n_words")).alias("echo"),
        ),
    )


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows of eight that occur twice or more in the text.

    A window is its 64-bit hash. Only texts in which a hash repeats are sorted; there, a window
    repeats if a neighbour in (hash, position) order has its hash, and the covered words are the
    union of [position, position + 8).
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
    )
    df = df.withColumn("_windows", F.when(F.size("_words") >= WINDOW, windows))
    ordered = F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    df = df.withColumn("_ordered", F.when(repeats, ordered))

    def shared(x, i):
        before = (i > 0) & (F.get("_ordered", i - 1)["h"] == x["h"])
        after = F.coalesce(F.get("_ordered", i + 1)["h"] == x["h"], F.lit(False))
        return before | after

    places = F.sort_array(F.transform(F.filter("_ordered", shared), lambda x: x["i"]))
    df = df.withColumn("_places", places)
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def sketches(df: DataFrame, lang: Column, source: Column, min_words: int) -> DataFrame:
    """(level, lang, source, measure, bucket, n): counts of every sketch at three levels.

    Documents of fewer than ``min_words`` words don't count; they are left out after the explode,
    because a filter below it would split their words a second time.
    """
    names = df.schema["measures"].dataType.names
    values = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col("measures")[m].alias("x"), "n_words")
            for m in names
        ]
    )
    bucket = F.when(F.col("v.x") <= SMALLEST, F.lit(0)).otherwise(
        F.ceil(F.log(F.col("v.x") / SMALLEST) / F.log(F.lit(GAMMA)))
    )
    finest = (
        df.select(lang.alias("lang"), source.alias("source"), F.explode(values).alias("v"))
        .where(F.col("v.n_words") >= min_words)
        .select("lang", "source", F.col("v.measure").alias("measure"), bucket.cast("int").alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Merging is adding: each finest sketch counts towards its language's and everybody's too.
    none = F.lit(None).cast("string")
    levels = F.array(
        *[
            F.struct(F.lit(level).alias("level"), a.alias("lang"), b.alias("source"))
            for level, a, b in ((2, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (0, none, none))
        ]
    )
    return (
        finest.select(F.inline(levels), "measure", "bucket", "n")
        .groupBy("level", "lang", "source", "measure", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def quantiles(sketch: DataFrame) -> DataFrame:
    """Quartile and median of every sketch; a group has at most a few hundred buckets per measure."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumns(
        {
            "upto": F.sum("n").over(group.orderBy("bucket")),
            "total": F.sum("n").over(group),
        }
    )
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(
        SMALLEST * 2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1)
    )
    reached = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return ranked.groupBy("level", "lang", "source", "measure").agg(
        F.max("total").alias("total"), reached(0.25).alias("q25"), reached(0.5).alias("q50")
    )


def thresholds(df: DataFrame, lang: Column, source: Column, config: RuleConfig) -> DataFrame:
    """One row per (lang, source): the bounds of each measure from the finest sketch large enough."""
    q = quantiles(sketches(df, lang, source, config.min_words))
    names = list(config.slacks())
    slack = F.create_map(*[F.lit(x) for kv in config.slacks().items() for x in kv])[F.col("measure")]
    reach = config.spread * (F.col("q50") - F.col("q25")) + slack
    bounds = q.withColumns({"low": F.col("q50") - reach, "high": F.col("q50") + reach})
    wide = bounds.groupBy("level", "lang", "source").agg(
        F.max("total").alias("docs"),
        *[
            F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(m)
            for m in names
        ],
    )
    enough = F.col("docs") >= config.min_docs
    pick = F.struct(*names)
    own = wide.where("level = 2").select(
        "lang", "source", F.when(enough, pick).alias("own")
    )
    by_lang = wide.where("level = 1").select(
        F.col("lang").alias("_lang"), F.when(enough, pick).alias("by_lang")
    )
    overall = wide.where("level = 0").select(pick.alias("overall"))
    return (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("overall", overall.scalar())
        .select("lang", "source", F.coalesce("own", "by_lang", "overall").alias("bounds"))
    )


def judged(docs: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Every row in a struct ``row``, with the struct ``quality``: counts, base_failed, kept.

    Two scans: one sketches the cheap measures of the documents long enough to judge, the other
    counts everything and meets the small table of thresholds.
    """
    text, lang, source = F.col("row.text"), F.col("row.lang"), F.col("row.source")
    slim = packed(docs.select("text", "lang", "source"))
    bounds = thresholds(_cheap(slim, text), lang, source, config)
    full = _repeated_words(_cheap(packed(docs), text))
    failed = (F.col("n_words") < config.min_words) | (
        100 * F.col("n_repeat_words") > config.most_repeated * F.col("n_words")
    )
    inside = F.lit(True)
    for m in config.slacks():
        value, bound = F.col("q.measures")[m], F.col("bounds")[m]
        inside = inside & (value <= bound["high"])
        if m == "length":
            inside = inside & (value >= bound["low"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "measures"]
    # An explode of one element: filters on the verdict stay above it. Below, they would be
    # written out in terms of the words and count everything once more for each mention.
    full = full.select("row", F.explode(F.array(F.struct(*counts, failed.alias("base_failed")))).alias("q"))
    bounds = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "bounds")
    met = full.join(
        bounds, lang.eqNullSafe(F.col("_lang")) & source.eqNullSafe(F.col("_source")), "left"
    )
    # A group all of whose documents are too short to judge has no bounds; they failed already.
    kept = ~F.col("q.base_failed") & F.coalesce(inside, F.lit(False))
    return met.select("row", F.struct("q.*", kept.alias("kept")).alias("quality"))


def keep_good(docs: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """The documents the rules keep, with their own columns."""
    return judged(docs, config).where("quality.kept").select("row.*")

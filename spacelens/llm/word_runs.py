"""Periodic runs of words: an enhanced suffix array with the branching-tandem test.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and
length at least ``max(min_length, min_exponent * q)`` that no neighbouring word extends with
period q. For each text: the suffix array (prefix doubling), its inverse ISA and the LCP table; for
each LCP interval of depth d, every suffix i outside the largest child checks whether i + d or
i - d lies in the interval too, by its ISA. A hit is a square of period d that the next word ends
("branching"). Each run has one such square per multiple of its period, at its right end; rotating
the square to the left, word by word, gives the start, and squares of one run are merged, smallest
period first. Intervals are kept as bounds on the arrays; no tree is built.

Each text is worked on by itself and whole, in one task; nothing is shuffled. Texts are handled in
pieces of a few megabytes, a longer text being a piece of its own. A run repeats all its words but
one period, and its root occurs once a period: texts without a repeat that long, and intervals
with fewer members, hold no run and are passed over; nothing else is.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text;
a null id is never looped; repeated rows are judged alike; an empty table gives an empty result;
the result holds ``carry`` and the named columns alone, so other input columns can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spacelens.llm.words import text_chunks


@dataclass(frozen=True)
class RunConfig:
    min_length: int = 6
    min_exponent: int = 4


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SA, ISA) by prefix doubling.

    ``words`` are codes; those of another text must differ, and each text must end with a code
    that occurs once, so that no comparison runs past it.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    sa = order.astype(np.int64)
    rank = np.empty(n, np.int64)

    def ranked(at: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks the sorted suffixes ``at``; returns which of them still share theirs."""
        new = np.ones(len(at), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        rank[at] = np.repeat(base[heads], sizes)
        return np.repeat(sizes > 1, sizes)

    open_ = np.flatnonzero(ranked(sa, words[sa], np.arange(n)))
    step = 1
    while len(open_):
        at = sa[open_]
        keys = rank[at] * np.int64(n + 1) + rank[at + step]
        by = np.argsort(keys, kind="stable")
        sa[open_] = at[by]
        open_ = open_[ranked(sa[open_], keys[by], open_)]
        step *= 2
    return sa, rank


def lcp_table(words: np.ndarray, sa: np.ndarray, isa: np.ndarray, shallow: int = 8) -> np.ndarray:
    """lcp[r]: common words of the suffixes at SA[r - 1] and SA[r]; lcp[0] = 0.

    The first words are compared for all suffixes at once; the rest in text order, where each
    value is at least the one before less the step, so that the work stays linear.
    """
    n = len(words)
    lcp = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for k in range(shallow):
        a, b = sa[live - 1] + k, sa[live] + k
        # A suffix that agreed so far has not met its text's last code, so k words follow.
        live = live[words[a] == words[b]]
        if not len(live):
            return lcp
        lcp[live] = k + 1
    deep = np.sort(sa[live])
    w = words.tolist()
    before = sa[isa[deep] - 1].tolist()
    out, last, length = [], 0, 0
    for i, j in zip(deep.tolist(), before):
        length = max(length - (i - last), shallow)
        while w[i + length] == w[j + length]:
            length += 1
        out.append(length)
        last = i
    lcp[isa[deep]] = out
    return lcp


def small_children(lcp: np.ndarray, first: int, last: int, members: int, deepest: int, out: list) -> None:
    """Adds (depth, interval from, to, child from, to) for the children of each LCP interval of
    one text, ranks first..last, but the largest child.

    Only intervals of at least ``members`` suffixes and a depth of at most ``deepest`` are given.
    """
    stack: list[tuple[int, int, list[int]]] = []
    for r, depth in enumerate(lcp[first + 1 : last + 1].tolist() + [0], first + 1):
        left = r - 1
        while stack and stack[-1][0] > depth:
            d, left, cuts = stack.pop()
            if r - left >= members and d <= deepest:
                edges = [left, *cuts, r]
                sizes = [b - a for a, b in zip(edges, edges[1:])]
                largest = sizes.index(max(sizes))
                out += [(d, left, r - 1, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if k != largest]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(r)
            else:
                stack.append((depth, left, [r]))


def branching_squares(words, sa, isa, children: list) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next word breaks the period."""
    if not children:
        none = np.zeros(0, np.int64)
        return none, none
    d, left, right, a, b = np.array(children, np.int64).T
    sizes = b - a
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = sa[np.repeat(a, sizes) + within]
    d, left, right = (np.repeat(x, sizes) for x in (d, left, right))
    n = len(words)
    starts, periods = [], []
    for j, start in ((i + d, i), (i - d, i - d)):
        inside = (j >= 0) & (j < n)
        place = isa[np.where(inside, j, 0)]
        hit = np.flatnonzero(inside & (place >= left) & (place <= right))
        s, p = start[hit], d[hit]
        hit = words[s + p] != words[s + 2 * p]
        starts.append(s[hit])
        periods.append(p[hit])
    return np.concatenate(starts), np.concatenate(periods)


def rotations(words: np.ndarray, first: int, start: int, period: int) -> int:
    """How often the square at ``start`` can be rotated to the left, down to ``first``."""
    turned, block = 0, 64
    while start - turned > first:
        low = max(first, start - turned - block)
        high = start - turned
        off = np.flatnonzero(words[low:high] != words[low + period : high + period])
        if len(off):
            return turned + high - 1 - low - int(off[-1])
        turned += high - low
        block *= 2
    return turned


def merged_runs(words, first: int, squares: list[tuple[int, int]], config: RunConfig) -> list[tuple[int, int, int]]:
    """(start, length, period) of one text's runs, by start and period, from its squares."""
    found: dict[int, list[tuple[int, int]]] = {}
    for end, period in sorted({(s + 2 * p, p) for s, p in squares}):
        own = found.setdefault(end, [])
        # A stretch of a smaller period that covers this square has it as a multiple.
        if any(start <= end - 2 * period for start, _ in own):
            continue
        start = end - 2 * period - rotations(words, first, end - 2 * period, period)
        own.append((start, period))
    runs = [
        (start - first, end - start, period)
        for end, own in found.items()
        for start, period in own
        if end - start >= max(config.min_length, config.min_exponent * period)
    ]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[np.ndarray], config: RunConfig = RunConfig()) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a text being an array of word codes from 0 up."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    keep = [k for k, t in enumerate(texts) if len(t) >= config.min_length]
    if not keep:
        return out
    own = [texts[k] for k in keep]
    lengths = np.array([len(t) + 1 for t in own])
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    span = int(max(t.max() for t in own)) + 2
    words = np.empty(bounds[-1], np.int64)
    for k, t in enumerate(own):
        # Codes of one text are its own, and 0 is its end, which sorts first.
        words[bounds[k] : bounds[k + 1] - 1] = t + 1 + k * span
        words[bounds[k + 1] - 1] = k * span
    sa, isa = suffix_array(words)
    lcp = lcp_table(words, sa, isa)
    # A run repeats all its words but one period: the least such number over all periods.
    e, short = config.min_exponent, config.min_length
    least = min(short - short // e, (e - 1) * -(-short // e))
    children: list = []
    for k in np.flatnonzero(np.maximum.reduceat(lcp, bounds[:-1]) >= least).tolist():
        # A text's suffixes hold the ranks that equal its positions.
        small_children(lcp, int(bounds[k]), int(bounds[k + 1]) - 1, e, int(lengths[k] - 1) // e, children)
    starts, periods = branching_squares(words, sa, isa, children)
    text = np.searchsorted(bounds, starts, "right") - 1
    for k in np.unique(text).tolist():
        mine = text == k
        squares = list(zip(starts[mine].tolist(), periods[mine].tolist()))
        out[keep[k]] = merged_runs(words, int(bounds[k]), squares, config)
    return out


def looped(n: int, g: int) -> np.ndarray:
    """For each word the original word it becomes: from word a on, every p words repeat."""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def _batch(table: pa.Table | pa.RecordBatch, carry: list[str], config: RunConfig):
    for first, data, offsets in text_chunks(table.column("text")):
        raw, edges = data.tobytes(), offsets.tolist()
        loops = table.column("loop").slice(first, len(edges) - 1).to_pylist()
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        texts, codes = [], []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            words = raw[a:b].split()
            if words and loops[k] is not None:
                words = [words[i] for i in looped(len(words), loops[k]).tolist()]
            texts.append(words)
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        runs = runs_of(codes, config)
        collapsed = []
        for words, own in zip(texts, runs):
            if own:
                drop = np.zeros(len(words), bool)
                for start, length, period in own:
                    drop[start + period : start + length] = True
                words = [words[i] for i in np.flatnonzero(~drop).tolist()]
            collapsed.append(b" ".join(words).decode("utf-8", "replace"))
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        found = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
        columns = [table.column(c).slice(first, len(edges) - 1) for c in carry]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.list_(span)), pa.array(collapsed, pa.string())],
            names=[*carry, "n_words", "runs", "collapsed"],
        )


def periodic_runs(
    docs: DataFrame,
    config: RunConfig = RunConfig(),
    carry: tuple[str, ...] = ("doc_id",),
    loop: Column | None = None,
) -> DataFrame:
    """(``carry``, n_words, runs, collapsed): runs as (start, length, period) by start and period;
    collapsed are the words that no run holds after its first period, joined by one space.

    ``loop``, a number or null for each row, first makes the text periodic (see ``looped``).
    """
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(
        F.col("text"),
        (F.lit(None) if loop is None else loop).cast("long").alias("loop"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)],
    )

    def work(batches):
        for batch in batches:
            yield from _batch(batch, names, config)

    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kept}{', ' if kept else ''}n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    out = rows.mapInArrow(work, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "n_words", "runs", "collapsed")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the longest run and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    # The smallest of (-length, start, period); null without runs.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = found.withColumn("best", best)
    length = -F.col("best.l")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        length.alias("length"),
        F.col("best.p").alias("period"),
        F.floor(1000 * length / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Signal documents: front matter between two '---' lines, then a free-text body."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spacelens.config import CONFIDENCE_WEIGHTS, DIRECTION_SIGNS

SIGNAL_SCHEMA = (
    "path string, id string, title string, category string, publisher string, source string, "
    "url string, published string, accessed string, confidence string, direction string, "
    "magnitude double, body string, molecules array<string>, segments array<string>, "
    "sub_segments array<string>, keywords array<string>"
)
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
TARGETS = ("molecules", "segments", "sub_segments", "keywords")


def _cut(text: str, at: str) -> list[str]:
    """``text`` cut at a character outside quotes and brackets."""
    parts, quote, depth = [""], "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not parts[-1].strip():
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        if c == at and not quote and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _plain(line: str) -> str:
    """The line without a comment: a mark outside quotes, at the start or after white space."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [,:\t" + c):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(t) for t in _cut(text[1:-1], ",") if t.strip()]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1].replace(text[0] * 2, text[0]) if text[0] == "'" else text[1:-1]
    return None if text in ("", "~", "null") else text


def header_fields(text: str) -> dict:
    """Key/value lines with quoted values and comments, one nested mapping level, '- item' and
    [a, b] lists, and indented block text after '|' (lines kept) or '>' (lines joined).

    The same reader everywhere: what a header means does not depend on a worker's packages.
    """
    out: dict = {}
    block: dict = out
    key = None
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        line = _plain(lines[at])
        at += 1
        if not line.strip():
            continue
        body, indented = line.strip(), line[:1].isspace()
        if (body.startswith("- ") or body == "-") and key is not None:
            if not isinstance(block.get(key), list):
                block[key] = []
            block[key].append(_scalar(body[2:]))
            continue
        name, found, value = body.partition(":")
        if not found or value and not value[0].isspace():
            raise ValueError(f"not a key/value line: {body}")
        if not indented:
            block = out
        elif block is out and key is not None:
            out[key] = {}
            block = out[key]
        key = name.strip().strip("\"'")
        if value.strip() in ("|", ">", "|-", ">-"):
            depth, kept = len(line) - len(line.lstrip()), []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > depth):
                kept.append(lines[at].strip())
                at += 1
            block[key] = ("\n" if value.strip()[0] == "|" else " ").join(kept).strip()
        else:
            block[key] = _scalar(value)
    return out


def _meta(text: str) -> tuple[dict | None, str]:
    """(fields, "") or (None, why the document cannot be used)."""
    try:
        meta = header_fields(text)
        if meta.get("id") is None:
            return None, "no id"
        float(meta.get("magnitude") or 0.0)
    except (ValueError, TypeError) as error:
        return None, str(error)
    return meta, ""


def _listed(value) -> list[str]:
    if value is None:
        return []
    items = value if isinstance(value, (list, tuple, set)) else [value]
    return [s for s in (str(i).strip() for i in items) if s]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SIGNAL_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for path, header, body in zip(batch["path"], batch["header"], batch["body"], strict=True):
            meta = _meta(header)[0]
            if meta is None:
                continue
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            applies = meta.get("applies_to")
            applies = applies if isinstance(applies, dict) else {}
            targets = {t: _listed(applies.get(t)) for t in TARGETS}
            text = {
                c: default if meta.get(c) is None else str(meta[c])
                for c, default in (
                    ("title", stem), ("category", "general"), ("publisher", ""), ("source", ""),
                    ("url", ""), ("published", ""), ("accessed", ""), ("confidence", "medium"),
                    ("direction", "neutral"),
                )
            }
            rows.append(
                {
                    "path": path,
                    "id": str(meta["id"]).strip(),
                    **text,
                    "magnitude": float(meta.get("magnitude") or 0.0),
                    "body": body.strip(),
                    **targets,
                    "molecules": [m.upper() for m in targets["molecules"]],
                    "keywords": [k.lower() for k in targets["keywords"]],
                }
            )
        yield pd.DataFrame(rows, columns=columns)


def _split(documents: DataFrame) -> DataFrame:
    return documents.select(
        "path",
        F.regexp_extract("value", FRONT_MATTER, 1).alias("header"),
        F.regexp_extract("value", FRONT_MATTER, 2).alias("body"),
        F.col("value").rlike(FRONT_MATTER).alias("ok"),
    )


def _faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        why = [_meta(h)[1] if ok else "no front matter" for h, ok in zip(batch["header"], batch["ok"], strict=True)]
        found = pd.DataFrame({"path": batch["path"], "reason": why})
        yield found[found["reason"] != ""]


def signal_errors(documents: DataFrame) -> DataFrame:
    """(path, reason) of the documents that ``parse_signals`` leaves out."""
    checked = _split(documents).select("path", "header", F.coalesce("ok", F.lit(False)).alias("ok"))
    return checked.mapInPandas(_faults, "path string, reason string")


def parse_signals(documents: DataFrame) -> DataFrame:
    """(path, value) whole-file rows to signals; documents in ``signal_errors`` are left out, the
    first path wins an id."""
    split = _split(documents).where("ok").drop("ok")
    parsed = split.mapInPandas(_parse, SIGNAL_SCHEMA)
    first = Window.partitionBy("id").orderBy("path")
    # The rank filter prunes before the shuffle, so many copies of one id stay cheap.
    return parsed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def read_signals(spark: SparkSession, directory: str) -> DataFrame:
    documents = (
        spark.read.option("pathGlobFilter", "*.md")
        .text(directory, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_signals(documents)


def signed_magnitude():
    """Direction sign x magnitude x confidence weight; unknown confidence counts half."""
    sign = F.lit(0.0)
    for name, value in DIRECTION_SIGNS.items():
        sign = F.when(F.lower("direction") == name, value).otherwise(sign)
    weight = F.lit(0.5)
    for name, value in CONFIDENCE_WEIGHTS.items():
        weight = F.when(F.lower("confidence") == name, value).otherwise(weight)
    return sign * F.col("magnitude") * weight


def citations(signals: DataFrame) -> DataFrame:
    return signals.select(
        "id", "title", "publisher", "source", "url", "published", "accessed", "confidence",
        F.when(F.col("url").startswith("internal://"), "Derived from supplied data")
        .otherwise("External source").alias("type"),
    ).orderBy("id")

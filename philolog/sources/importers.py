"""Importers: from decoded source files to units of text.

Each takes files (source_id, filename, language, text) and gives sentence rows: document_id,
paragraph_no, sentence_no, language, sentence, and, where the source is tagged, tokens with pos.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from philolog.functions import text as X
from philolog.sources.structure import structured

#: Fixed: a word with its tag.
ZH_TAGGED, EN_TAGGED = r"^(.+)/([A-Za-z][A-Za-z0-9_-]*)$", r"^(.+)_([A-Z0-9$-]+)$"
UNITS = T.ArrayType(T.StructType([T.StructField("paragraph_no", T.IntegerType()), T.StructField("paragraph", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))]))
STEP_TYPE = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("a_from", "a_to", "b_from", "b_to")), T.StructField("confidence", T.DoubleType())]))


def raw_mono(files: DataFrame) -> DataFrame:
    """Paragraphs, then sentences; sentences are numbered through the document."""
    parts = files.select(F.col("source_id").alias("document_id"), "language", F.posexplode(X.paragraphs(F.coalesce("text", F.lit("")))).alias("p", "paragraph"))
    rows = parts.select("document_id", "language", F.col("p"), F.posexplode(X.sentences(F.col("paragraph"), F.col("language"))).alias("s", "sentence"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("p", "s"))
    return rows.select("document_id", (F.col("p") + 1).alias("paragraph_no"), number.alias("sentence_no"), "language", "sentence")


def title_of(text):
    """The first line that isn't blank, 200 characters at most."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 200)


def tagged(files: DataFrame) -> DataFrame:
    """word/POS (zh) or word_POS (en); a line is a sentence; structure marks are taken out, untagged items left out and counted."""
    parts = files.select(F.col("source_id").alias("document_id"), "language", F.posexplode(X.paragraphs(F.coalesce("text", F.lit("")))).alias("p", "paragraph"))
    rows = parts.select("*", F.posexplode(F.split("paragraph", "\n")).alias("l", "line"))
    rows = rows.withColumn("items", F.filter(F.split(X.compact(F.regexp_replace("line", "<[^>]*>", " ")), " "), lambda x: x != ""))

    def parsed(pattern: str):
        cut = F.transform("items", lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("word"), F.regexp_extract(x, pattern, 2).alias("pos")))
        return F.filter(cut, lambda t: t["word"] != "")

    rows = rows.withColumn("tokens", F.when(F.col("language") == "zh", parsed(ZH_TAGGED)).otherwise(parsed(EN_TAGGED)))
    rows = rows.withColumn("skipped", F.size("items") - F.size("tokens")).where(F.size("tokens") > 0)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("p", "l"))
    words = F.transform("tokens", lambda t: t["word"])
    sentence = F.when(F.col("language") == "zh", F.array_join(words, "")).otherwise(F.array_join(words, " "))
    return rows.select("document_id", (F.col("p") + 1).alias("paragraph_no"), number.alias("sentence_no"), "language", sentence.alias("sentence"), "tokens", "skipped")


def _xml_units(text: str) -> list[dict]:
    root = ET.fromstring(f"<all>{re.sub(r'^\s*<\?xml[^>]*\?>', '', text, count=1, flags=re.I)}</all>")
    whole = lambda e: " ".join("".join(e.itertext()).split())
    out = []
    for p, element in enumerate(list(root.iter("p")) or [root], 1):
        if paragraph := whole(element):
            out.append({"paragraph_no": p, "paragraph": paragraph, "sentences": [s for e in element.iter("s") if (s := whole(e))]})
    return out


@F.pandas_udf(UNITS)
def xml_units(text: pd.Series) -> pd.Series:
    """Paragraphs and marked sentences; a text that does not parse gives null."""

    def units(t: str | None):
        try:
            return _xml_units(t or "")
        except ET.ParseError:
            return None

    return text.map(units)


def xml_like(files: DataFrame) -> DataFrame:
    """<p> are paragraphs and <s> sentences; without <s> a paragraph is split by its stops. Files that don't parse are absent."""
    language = F.when(F.col("language").isin("zh", "en"), F.col("language")).otherwise("zh")
    parts = files.select(F.col("source_id").alias("document_id"), language.alias("language"), F.explode(xml_units("text")).alias("u")).select("document_id", "language", "u.*")
    own = F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(X.sentences(F.col("paragraph"), F.col("language")))
    rows = parts.select("document_id", "language", "paragraph_no", F.posexplode(own).alias("s", "sentence"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("paragraph_no", "s"))
    return rows.select("document_id", "paragraph_no", number.alias("sentence_no"), "language", "sentence")


def aligned_table(lines: DataFrame) -> DataFrame:
    """Pairs of a two-column table (line_no, line): a header is passed over, a row without both sides is an error row."""
    cells = F.split("line", "\t")
    rows = lines.where(F.trim("line") != "").withColumn("a_text", F.trim(F.get(cells, F.lit(0)))).withColumn("b_text", F.trim(F.coalesce(F.get(cells, F.lit(1)), F.lit(""))))
    first = lines.where(F.trim("line") != "").agg(F.min("line_no").alias("first"))
    header = (F.col("line_no") == F.col("first")) & F.lower(F.replace("line", F.lit(" "), F.lit(""))).rlike(r"^(?:zh\ten|cn\ten|chinese\tenglish)\r?$")
    rows = rows.crossJoin(F.broadcast(first)).where(~header)  # one row
    return rows.select(F.col("line_no").alias("pair_no"), "a_text", "b_text", F.lit("sentence").alias("alignment_unit"), F.lit("provided").alias("method"), F.lit(1.0).alias("confidence"), ((F.col("a_text") == "") | (F.col("b_text") == "")).alias("is_error"))


#: Fixed: steps of an alignment with their costs; bounds of the length ratio; highest confidences.
STEPS = {(1, 1): 0.0, (1, 2): 0.35, (2, 1): 0.35, (1, 0): 1.2, (0, 1): 1.2}
RATIO_BOUNDS, SURE, LESS_SURE = (0.5, 8.0), 0.95, 0.82


#: Steps in the order in which equally cheap ones are preferred, and the first width of the band.
_ORDER, FIRST_WIDTH = ((2, 1), (1, 2), (1, 1), (1, 0), (0, 1)), 64


def align_lengths(a: list[int], b: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Cheapest alignment of two lists of lengths as (from a, to a, from b, to b, confidence).

    Costs are worked out diagonal by diagonal, four of which are kept, within a band round the line
    from start to end; each cell of the band keeps its step in a byte. A path that leaves the band
    takes steps that aren't one to one on its way out and back, so it costs more than a bound; if the
    cheapest path within the band doesn't stay below that, the band is made wider.
    """
    ratio = min(max(sum(b) / max(sum(a), 1), RATIO_BOUNDS[0]), RATIO_BOUNDS[1])
    n, m, width = len(a), len(b), FIRST_WIDTH
    uneven = min(cost for (da, db), cost in STEPS.items() if da != db)
    while True:
        cost, steps = _banded(a, b, ratio, width)
        if cost < uneven * (2 * (width + 1) + abs(m - n)) or width >= n + m:
            break
        width *= 4
    out, i, j = [], n, m
    while i or j:
        first, codes = steps[i + j]
        da, db = _ORDER[codes[i - first]]
        top = 0.0
        if da and db:
            stretch = abs(math.log((sum(b[j - db : j]) + 1) / (sum(a[i - da : i]) * ratio + 1)))
            top = (SURE if da == db == 1 else LESS_SURE) * math.exp(-stretch)
        out.append((i - da, i, j - db, j, round(top, 4)))
        i, j = i - da, j - db
    return out[::-1]


def _banded(a: list[int], b: list[int], ratio: float, width: int) -> tuple[float, dict[int, tuple[int, np.ndarray]]]:
    """The least cost within a band, and for each diagonal its first place in a and the places' steps."""
    n, m = len(a), len(b)
    low, high = min(0, m - n) - width, max(0, m - n) + width
    # two places before the start let every step look back
    sums = [np.concatenate((np.zeros(2), np.cumsum([0, *x], dtype=np.float64))) for x in (a, b)]
    costs = {0: np.full(n + 3, np.inf)}
    costs[0][2] = 0.0
    steps: dict[int, tuple[int, np.ndarray]] = {}
    for d in range(1, n + m + 1):
        first, last = max(0, d - m, -((high - d) // 2)), min(n, d, (d - low) // 2)
        here = np.full(n + 3, np.inf)
        if first <= last:
            i = np.arange(first, last + 1)
            j = d - i
            best, code = np.full(len(i), np.inf), np.full(len(i), -1, np.int8)
            for k, (da, db) in enumerate(_ORDER):
                before = costs.get(d - da - db)
                if before is None:
                    continue
                cost = before[i + 2 - da]
                if da and db:
                    long_a, long_b = sums[0][i + 2] - sums[0][i + 2 - da], sums[1][j + 2] - sums[1][j + 2 - db]
                    cost = cost + np.abs(np.log((long_b + 1) / (long_a * ratio + 1)))
                cost = cost + STEPS[da, db]
                better = cost < best
                best[better], code[better] = cost[better], k
            here[first + 2 : last + 3] = best
            steps[d] = (first, code)
        costs[d] = here
        costs.pop(d - 3, None)
    return float(costs[n + m][n + 2]), steps


@F.pandas_udf(STEP_TYPE)
def aligned_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("a_from", "a_to", "b_from", "b_to", "confidence"), x, strict=True)) for x in align_lengths(list(p), list(q))] for p, q in zip(a, b, strict=True)])


def paired_paragraphs(pairs: DataFrame) -> DataFrame:
    """pair_id, a_text, b_text (whole files) to aligned paragraphs: pair_no, both texts, method, confidence (0 for a gap)."""
    rows = pairs.select("pair_id", X.paragraphs(F.col("a_text")).alias("a"), X.paragraphs(F.col("b_text")).alias("b"))
    size = lambda c: F.transform(c, X.visible_length)
    rows = rows.where((F.size("a") > 0) & (F.size("b") > 0)).withColumn("steps", aligned_lengths(size("a"), size("b")))
    rows = rows.select("pair_id", "a", "b", F.posexplode("steps").alias("i", "s")).select("pair_id", "a", "b", "i", "s.*")
    side = lambda c: F.array_join(F.slice(c, F.col(f"{c}_from") + 1, F.col(f"{c}_to") - F.col(f"{c}_from")), "\n")
    method = F.concat_ws("_", F.lit("automatic_length_dp"), F.col("a_to") - F.col("a_from"), F.col("b_to") - F.col("b_from"))
    return rows.select("pair_id", (F.col("i") + 1).alias("pair_no"), side("a").alias("a_text"), side("b").alias("b_text"), F.lit("paragraph").alias("alignment_unit"), method.alias("method"), "confidence")


_OPENING = re.compile(r"<\s*(p|s)\b([^>]*)>", re.I)
_NUMBER = re.compile(r"n\s*=\s*[\"']?(\d+)", re.I)


def structure_units(text: str, tag: str) -> list[dict]:
    """Units opened by <p ...> or <s ...>, each up to the next one; loose spelling of marks is allowed."""
    opened = [m for m in _OPENING.finditer(text) if m[1].lower() == tag]
    out = []
    for k, m in enumerate(opened):
        body = text[m.end() : opened[k + 1].start() if k + 1 < len(opened) else len(text)]
        number = _NUMBER.search(m[2])
        clean = " ".join(re.sub(r"<[^>]*>", " ", body).split())
        if clean:
            out.append({"number": int(number[1]) if number else None, "text": clean})
    return out


def paired_structure(pairs: DataFrame, tag: str = "s") -> DataFrame:
    """Units of two tagged files joined by number and by which occurrence of the number they are; by order if all numbers agree in order."""

    @F.pandas_udf("array<struct<number:int,text:string>>")
    def units(text: pd.Series) -> pd.Series:
        return text.map(lambda t: structure_units(t or "", tag))

    rows = pairs.select("pair_id", units("a_text").alias("a"), units("b_text").alias("b"))
    numbers = lambda c: F.transform(c, lambda u: u["number"])
    rows = rows.withColumn("same", F.coalesce(numbers("a"), F.array().cast("array<int>")) .eqNullSafe(F.coalesce(numbers("b"), F.array().cast("array<int>"))))
    sides = []
    for c in ("a", "b"):
        side = rows.select("pair_id", "same", F.posexplode(c).alias("i", "u")).select("pair_id", "same", "i", F.col("u.number").alias("number"), F.col("u.text").alias(f"{c}_text"))
        nth = F.row_number().over(Window.partitionBy("pair_id", "number").orderBy("i"))
        key = F.when(F.col("same"), F.struct(F.lit(-1).alias("n"), F.col("i").alias("k"))).when(F.col("number").isNotNull(), F.struct(F.col("number").alias("n"), nth.alias("k")))
        sides.append(side.withColumn("key", key).where("key is not null").select("pair_id", "key", f"{c}_text", F.col("i").alias(f"{c}_i")))
    met = sides[0].join(sides[1], ["pair_id", "key"])
    return met.select("pair_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("a_i")).alias("pair_no"), "a_text", "b_text", F.lit("provided_structure").alias("method"), F.lit(1.0).alias("confidence"))


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "raw_mono": raw_mono, "tagged": tagged, "xml_like": xml_like, "aligned_tsv": aligned_table, "paired_raw": paired_paragraphs, "paired_tagged": paired_structure,
    "tagged_structure": structured,
}

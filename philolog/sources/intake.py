"""Intake of a folder of text files: scan, decode, classify, pair, and a manifest."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns of marks in files.
CJK, LATIN = r"[一-鿿]", r"[A-Za-z]"
XML_TAG = r"(?i)</?(?:head|p|s|date|author)(?:\s[^>]*)?>"
ZH_POS, EN_POS = r"(?U)[一-鿿A-Za-z0-9]+/[a-zA-Z]{1,8}\b", r"(?U)\b[A-Za-z][A-Za-z'’.-]*_[A-Z0-9$]{1,10}\b"
DATE = (
    r"(?iU)(?:\d{4}[-/.年]\d{1,2}(?:[-/.月]\d{1,2})?日?|[一二三四五六七八九〇零]{4}年[一二三四五六七八九十〇零]{1,3}月(?:[一二三四五六七八九十〇零]{1,3}日)?"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"
)
STAGE = r"(?iU)\bM\d+\b"
AUTHORS = ("习近平", "毛泽东", "邓小平", "江泽民", "胡锦涛", "Xi Jinping", "Mao Zedong", "Deng Xiaoping", "Jiang Zemin", "Hu Jintao")
#: Fixed: characters that are sampled, lines that are looked at, least counts.
SAMPLE, TAB_LINES, PAIR_LINES, LEAST_LETTERS, LEAST_MARKS, TITLE = 12000, 200, 50, 20, 5, 120


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, relative_path, filename, size_bytes, content of .txt and .tsv files below a folder, whatever their letters' case; lock files of office programs are left out.

    In the order of lower-cased relative paths once sorted by `scan_order`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xXsS][tTvV]").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    relative = F.substring_index("path", base, -1)
    files = files.where(~name.startswith("~$") & F.lower(name).rlike(r"\.(?:txt|tsv)$"))
    return files.select("path", relative.alias("relative_path"), name.alias("filename"), F.col("length").alias("size_bytes"), F.lower(relative).alias("scan_order"), "content")


#: Fixed: byte-order marks; encodings that are tried; what a character of each kind adds to a text's readability; characters looked at.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
ENCODINGS = ("utf-8-sig", "gb18030", "utf-16-le", "utf-16-be")
PER_LETTER, PER_BLANK, PER_CONTROL, PER_REPLACED, LOOKED_AT = 0.001, 0.0002, -0.02, -0.5, 4000


def readability(text: str) -> float:
    """Higher for text with letters and blanks, lower with control characters."""
    kinds = Counter("control" if c < " " and c not in "\r\n\t" else "replaced" if c == "�" else "blank" if c in " \n" else "other" for c in text[:LOOKED_AT])
    size = min(len(text), LOOKED_AT)
    if not size:
        return -1.0
    shown = sum(c.isprintable() or c in "\r\n\t" for c in text[:LOOKED_AT]) / size
    letters = len(re.findall(f"{LATIN}|{CJK}", text[:LOOKED_AT]))
    return shown + PER_LETTER * letters + PER_BLANK * kinds["blank"] + PER_CONTROL * kinds["control"] + PER_REPLACED * kinds["replaced"]


def _decodable(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def decode_bytes(data: bytes) -> tuple[str, str]:
    """Text and encoding: by byte-order mark, else the most readable of four (of equals the first), else UTF-8 with replacements."""
    if marked := next((e for mark, e in MARKS.items() if data.startswith(mark)), None):
        return data.decode(marked), marked
    texts = {e: t for e in ENCODINGS if (t := _decodable(data, e)) is not None}
    if not texts:
        return data.decode("utf-8", "replace"), "utf-8-replace"
    best = max(texts, key=lambda e: readability(texts[e]))
    return texts[best], best


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(bytes(x or b"")) for x in content], columns=["text", "encoding"])


def detect_language(cjk: Column, latin: Column) -> Column:
    return F.when(cjk >= F.greatest(F.lit(LEAST_LETTERS), latin * 2), "zh").when(latin >= F.greatest(F.lit(LEAST_LETTERS), cjk * 2), "en").when((cjk > 0) & (latin > 0), "mixed").otherwise("unknown")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "</?[^>]+>", "")


def strip_pos(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)/[a-zA-Z]{1,8}\b", ""), r"(?U)_[A-Z$]{1,10}\b", "")


def _aligned(lines: Column) -> Column:
    first = F.replace(F.lower(F.get(lines, F.lit(0))), F.lit(" "), F.lit(""))
    header = first.contains("\t") & (first.isin("zh\ten", "cn\ten", "chinese\tenglish") | (first.contains("zh") & first.contains("en")))
    tabbed = F.filter(F.slice(lines, 1, PAIR_LINES), lambda x: x.contains("\t"))
    both = F.filter(tabbed, lambda x: F.substring_index(x, "\t", 1).rlike(CJK) & F.substring(x, F.instr(x, "\t") + 1, F.length(x)).rlike(LATIN))
    many = F.size(F.filter(F.slice(lines, 1, TAB_LINES), lambda x: x.contains("\t"))) >= 2
    return F.coalesce(header, F.lit(False)) | (many & (F.size(tabbed) >= 2) & (F.size(both) >= F.greatest(F.lit(2), F.floor(F.size(tabbed) / 2))))


def classify(files: DataFrame, text_col: str = "text", name_col: str = "filename") -> DataFrame:
    """Adds detected_type, detected_language, confidence, title_guess, date_guess, author, stage_or_period, notes.

    In this order: aligned table, tagged, XML-like, raw text, unknown; blank text is unknown at 0.1.
    """
    text, name = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(name_col), F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]"), lambda x: F.regexp_replace(x, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")), lambda x: x != "")
    work = files.withColumn("_lines", lines).withColumn("_head", F.substring(text, 1, SAMPLE))
    for key, pattern in (("cjk", CJK), ("latin", LATIN), ("zh", ZH_POS), ("en", EN_POS), ("xml", XML_TAG)):
        work = work.withColumn(f"_{key}", F.regexp_count("_head", F.lit(pattern)))
    blank = F.size("_lines") == 0
    language = detect_language(F.col("_cjk"), F.col("_latin"))
    kinds = [
        (blank, "unknown", F.lit("unknown"), 0.1),
        (_aligned(F.col("_lines")), "aligned_tsv", F.lit("zh_en"), 0.95),
        ((F.col("_zh") >= LEAST_MARKS) & (F.col("_zh") >= F.col("_en")), "tagged_zh", F.lit("zh"), 0.9),
        (F.col("_en") >= LEAST_MARKS, "tagged_en", F.lit("en"), 0.9),
        (F.col("_xml") >= 2, "xml_like", language, 0.82),
        (language == "zh", "raw_zh", F.lit("zh"), 0.78),
        (language == "en", "raw_en", F.lit("en"), 0.78),
    ]
    kind, lang, sure = F.lit("unknown"), F.lit("unknown"), F.lit(0.2)
    for condition, k, language_of, c in reversed(kinds):
        kind, lang, sure = F.when(condition, k).otherwise(kind), F.when(condition, language_of).otherwise(lang), F.when(condition, c).otherwise(sure)
    clean = F.transform("_lines", lambda x: F.trim(strip_tags(strip_pos(x))))
    title = F.get(F.filter(clean, lambda x: (x != "") & (F.length(x) <= TITLE) & ~F.regexp_replace(x, "^[（）() ]+|[（）() ]+$", "").rlike(f"{DATE[:5]}^(?:{DATE[5:]})$")), F.lit(0))
    top = F.concat_ws("\n", name, F.array_join(F.slice("_lines", 1, 6), "\n"))
    by = F.concat_ws("\n", name, F.array_join(F.slice("_lines", 1, 8), "\n"))
    author = F.coalesce(*[F.when(by.contains(a), a) for a in AUTHORS], F.lit(""))
    notes = F.when(blank, F.array(F.lit("empty_file"))).otherwise(
        F.array_compact(F.array(
            F.when(F.col("_xml") > 0, "xml_like_tags"), F.when(kind == "aligned_tsv", "tabular_parallel_text"),
            F.when(kind == "tagged_zh", F.concat(F.lit("zh_pos_matches="), F.col("_zh"))), F.when(kind == "tagged_en", F.concat(F.lit("en_pos_matches="), F.col("_en"))),
            F.when(kind == "unknown", "insufficient_language_signal"),
        ))
    )
    return work.select(
        *files.columns, kind.alias("detected_type"), lang.alias("detected_language"), sure.alias("confidence"), F.coalesce(title, F.lit("")).alias("title_guess"),
        F.when(blank, "").otherwise(F.regexp_extract(top, DATE, 0)).alias("date_guess"), F.when(blank, "").otherwise(author).alias("author"), F.when(blank, "").otherwise(F.upper(F.regexp_extract(name, STAGE, 0))).alias("stage_or_period"), notes.alias("notes"),
    )


def normalized_name(part: Column) -> Column:
    out = F.regexp_replace(F.lower(part), r"(?U)\b(?:raw|txt|pos|untagged|unalignment|alignment)\b", "")
    out = F.regexp_replace(out, "中文|中译|中|官译|英文|英语|英译|外译|译文|原文|段对齐", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)[_\-\s]+", "-"), "^-+|-+$", "")


def pair_key(path: Column, tagged: bool) -> Column:
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    number = F.regexp_extract(stem, r"^\s*(\d+)\s*(?:-|$)", 1)
    own = F.when(F.lit(tagged) & (number != ""), number).otherwise(normalized_name(stem))
    folders = F.filter(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), normalized_name), lambda x: x != "")
    return F.when(F.size(folders) > 0, F.concat_ws("/", F.array_join(folders, "/"), own)).otherwise(own)


def detect_pairs(manifest: DataFrame, path_col: str = "original_path") -> DataFrame:
    """Adds probable_pair_id and pair_key, and turns the type and confidence of paired files.

    Raw files pair if a key has both languages; tagged files if it has exactly one of each. Raw pairs
    are numbered first, each in the order of keys.
    """
    kind = F.when(F.col("detected_type").isin("raw_zh", "raw_en"), 0).when(F.col("detected_type").isin("tagged_zh", "tagged_en"), 1)
    rows = manifest.withColumn("_kind", kind).withColumn("_key", F.when(kind == 1, pair_key(F.col(path_col), True)).otherwise(pair_key(F.col(path_col), False)))
    sides = rows.where("_kind is not null").groupBy("_kind", "_key").agg(F.sum((F.col("detected_language") == "zh").cast("int")).alias("z"), F.sum((F.col("detected_language") == "en").cast("int")).alias("e"))
    good = sides.where("(_kind = 0 and z > 0 and e > 0) or (_kind = 1 and z = 1 and e = 1)")
    good = good.select("_kind", "_key", F.concat(F.lit("pair-"), F.lpad(F.row_number().over(Window.orderBy("_kind", "_key")).cast("string"), 4, "0")).alias("probable_pair_id"))
    rows = rows.join(good, ["_kind", "_key"], "left").withColumn("_paired", F.col("probable_pair_id").isNotNull())
    rows = rows.withColumn("detected_type", F.when(F.col("_paired") & (F.col("_kind") == 0), "paired_raw_zh_en").when(F.col("_paired"), "paired_tagged_zh_en").otherwise(F.col("detected_type")))
    rows = rows.withColumn("confidence", F.when(F.col("_paired"), F.greatest("confidence", F.when(F.col("_kind") == 0, 0.86).otherwise(0.95))).otherwise(F.col("confidence")))
    return rows.withColumn("pair_key", F.when(F.col("_paired"), F.col("_key"))).drop("_kind", "_key", "_paired")


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("detected_type", "detected_language").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("probable_pair_id").alias("pairs"), F.sum("size_bytes").alias("bytes"))


#: Fixed: what a declared corpus type may hold.
ALLOWED = {
    "raw_mono": ("raw_zh", "raw_en"), "tagged": ("tagged_zh", "tagged_en"), "xml_like": ("xml_like",), "aligned_tsv": ("aligned_tsv",),
    "paired_raw": ("raw_zh", "raw_en", "paired_raw_zh_en"), "paired_tagged": ("tagged_zh", "tagged_en", "paired_tagged_zh_en"),
}


def mismatched(manifest: DataFrame, declared_type: str, declared_language: str) -> DataFrame:
    """Files whose content is not of the declared type or language."""
    wrong = ~F.col("detected_type").isin(*ALLOWED[declared_type])
    return manifest.where(wrong | ((F.lit(declared_language) != "zh_en") & (F.col("detected_language") != declared_language)))

"""Personal data in texts, in DataFrame functions alone.

Four kinds have base patterns whose spans are always reported. Beside them, one broad generator a kind
proposes spans (anything round an @, runs of digits and separators), so proposals overlap. Boosted
trees of each kind over features of a proposal's format and of its context give it a margin, and those
at or above the kind's calibrated margin are added, unless a base span covers them. Labels are weak: a
base match, or the kind's usual size and grouping with a cue near by. The trees don't see the feature
that the base pattern is strict about. They are fitted on counts of feature combinations over all
documents, and calibrated on documents kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from philolog.llm import boosting
from philolog.llm._session import checkpoints

#: Fixed order of kinds in results.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no start or end is tried twice: a start within a run of local
#: characters or digits cannot match if the run's own start does not, unless a match has just ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the generators propose. Marks at a span's ends are not part of it.
PROPOSALS = {
    "email": r"(?<![^\s@<>(),;:\"'\[\]])[^\s@<>(),;:\"'\[\]]++@[^\s@<>(),;:\"'\[\]]*[\p{L}0-9]",
    "ip": r"(?<![0-9.])[0-9]++(?:[.:,][0-9]++){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.\-]{0,2}[0-9])++",
    "phone": r"(?<![0-9+(])[+(]{0,2}[0-9](?:[\x20().\-/]{0,3}[0-9])++",
}
#: Fixed: lower-case words that announce personal data.
CUES = {
    "email": r"(?:mail|contact|write to|address)\W{0,3}(?:(?:is|at|me|us)\W{1,3})?$",
    "ip": r"(?:\bip|address|server|host)\W{0,3}(?:(?:is|at)\W{1,3})?$",
    "card": r"(?:card|visa|credit|mastercard)\W{0,3}(?:(?:number|no|is)\W{1,3})?$",
    "phone": r"(?:contact|phone|\btel|telephone|\bcall|\bfax|mobile|\bcell)\W{0,3}(?:(?:number|no|is|at|me|us)\W{1,3})?$",
}
#: What a kind's base pattern is strict about, which its trees don't see.
HIDDEN = {"email": ("domain",), "ip": ("octets",), "card": ("luhn",), "phone": ("plus",)}
#: Boosting rounds, share of proposals above the margin that must be labelled, characters before a proposal that are looked at.
ROUNDS, PRECISION, BEFORE = 15, 0.98, 24
#: Array entries that are summed at once.
CHUNK = 256
NAMES = ("at", "digits", "dots", "separators", "plus", "paren", "luhn", "octets", "letters", "domain", "cue", "before", "after")
#: Upper ends of the bins of digit counts.
DIGIT_BINS = (0, 3, 6, 7, 11, 15, 16, 19)


def running(lengths: Column) -> Column:
    """Sums of all entries before each entry, in chunks so that long arrays stay cheap."""
    zero = F.array(F.lit(0).cast("long"))

    def before(of: Column) -> Column:
        """One entry more than given: the last is the sum of all."""
        return F.aggregate(of, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(lengths, i, F.lit(CHUNK)))
    starts = before(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))
    # what a lambda takes from outside is worked out anew for each entry, so everything comes in by zipping
    inner = F.transform(chunks, lambda c: F.slice(before(c), F.lit(1), F.size(c)))
    return F.flatten(F.zip_with(F.slice(starts, F.lit(1), F.size(chunks)), inner, lambda s, c: F.transform(c, lambda x: x + s)))


def _found(docs: DataFrame, name: str, pattern: str, possible: Column) -> DataFrame:
    """Adds `name`: array of (text, start, end, gap, next) of all matches in order; gap is the text since the match before."""
    text = F.when(possible, F.col("text"))
    docs = docs.withColumn("_hit", F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
    docs = docs.withColumn("_gap", F.when(F.size("_hit") > 0, F.split(F.col("text"), pattern, -1)).otherwise(F.array().cast("array<string>")))
    lengths = F.zip_with("_hit", F.slice("_gap", F.lit(1), F.size("_hit")), lambda x, g: (F.length(x) + F.length(g)).cast("long"))
    offsets = F.when(F.size("_hit") > 0, running(lengths)).otherwise(F.array().cast("array<long>"))
    after = F.when(F.size("_hit") > 0, F.slice("_gap", F.lit(2), F.size("_hit")))
    docs = docs.withColumn("_all", F.arrays_zip(F.col("_hit").alias("hit"), F.slice("_gap", F.lit(1), F.size("_hit")).alias("gap"), offsets.alias("offset"), F.coalesce(after, F.array().cast("array<string>")).alias("next")))

    def one(m: Column) -> Column:
        start = m["offset"] + F.length(m["gap"])
        return F.struct(m["hit"].alias("text"), start.alias("start"), (start + F.length(m["hit"])).alias("end"), F.substring(m["gap"], -BEFORE, BEFORE).alias("gap"), F.substring(m["next"], 1, 1).alias("next"))

    return docs.withColumn(name, F.transform("_all", one)).drop("_hit", "_gap", "_all")


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right is doubled, less 9 above 9."""
    figures = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(figures, F.lit(0), lambda acc, v: acc + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def octets(x: Column) -> Column:
    return ~F.exists(F.split(x, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(digits_of(x))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(digits_of(x))).otherwise(False)
    return {"email": F.lit(True), "ip": octets(x), "phone": n.between(8, 15)}[kind]


def _kept(kind: str) -> Column:
    """Of the matches in the column named after a kind, the valid ones as (kind, start, end)."""
    return F.transform(F.filter(kind, lambda s: _valid(kind, s["text"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["end"] - b["end"])).cast("int"))


def _with_added(kind: str) -> Column:
    return _in_order(F.array_union(F.col(kind), F.filter("added", lambda s: s["kind"] == kind)))


def _usual(kind: str, x: Column) -> Column:
    """Whether a proposal has the size and grouping that its kind usually has, strict or not."""
    n = F.length(digits_of(x))
    return {
        "email": x.rlike(r"^[\p{L}0-9._%+-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*$"),
        "ip": x.rlike(r"^[0-9]{1,3}(?:[.:,][0-9]{1,3}){3}$"),
        "card": n.between(13, 19) & x.rlike(r"^[0-9]{4}(?:([\x20.-]?)[0-9]{2,6}){2,4}$"),
        "phone": n.between(7, 15) & x.rlike(r"^[+(]{0,2}[0-9]{1,4}(?:[\x20().\-/]{1,3}[0-9]{2,4}){1,5}$"),
    }[kind]


def _base(kind: str, x: Column) -> Column:
    """Whether a whole proposal is a base match of its kind."""
    return F.when(x.rlike(f"^(?:{PATTERNS[kind]})$"), _valid(kind, x)).otherwise(False)


def _class_of(c: Column) -> Column:
    """0: nothing or space, 1: letter, 2: digit, 3: other."""
    return F.when((F.length(c) == 0) | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _features(kind: str, c: Column) -> Column:
    x, digits = c["text"], digits_of(c["text"])
    n = F.length(digits)
    binned = F.lit(len(DIGIT_BINS))
    for i, top in reversed(list(enumerate(DIGIT_BINS))):
        binned = F.when(n <= top, i).otherwise(binned)
    dots = F.length(F.regexp_replace(x, r"[^.]", ""))
    letters = F.length(F.regexp_replace(x, r"\P{L}", ""))
    values = {
        "at": x.contains("@").cast("int"),
        "digits": binned,
        "dots": F.least(dots, F.lit(4)),
        "separators": F.least(F.length(F.regexp_replace(x, r"[^\x20()\-]", "")), F.lit(3)),
        "plus": x.startswith("+").cast("int"),
        "paren": x.contains("(").cast("int"),
        "luhn": F.when(n.between(16, 19), luhn(digits)).otherwise(False).cast("int"),
        "octets": F.when(dots == 3, octets(x)).otherwise(False).cast("int"),
        "letters": F.when(letters == 0, 0).when(letters < 4, 1).otherwise(2),
        "domain": x.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9]").cast("int"),
        "cue": F.lower(c["gap"]).rlike(CUES[kind]).cast("int"),
        "before": _class_of(F.substring(c["gap"], -1, 1)),
        "after": _class_of(c["next"]),
    }
    return F.struct(x.alias("text"), c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind"), (_base(kind, x) | (_usual(kind, x) & (values["cue"] == 1))).cast("int").alias("y"), *(values[k].cast("int").alias(k) for k in NAMES))


def _proposed(kind: str) -> Column:
    """Matches in the column _p with enough digits for the kind, with their features."""
    least = {"email": 0, "ip": 4, "card": 13, "phone": 7}[kind]
    return F.transform(F.filter("_p", lambda c: F.length(digits_of(c["text"])) >= least), lambda c: _features(kind, c))


def _chosen(kind: str, names: list[str], prior: float, trees: list, least: float) -> Column:
    return F.filter("proposed", lambda c: F.when(c["kind"] == kind, boosting.margin_column([c[k] for k in names], prior, trees) >= least).otherwise(False))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, counts of base spans by kind, base_sha256, `spans` (one string) and `found`.

    found is the array of all spans (kind, start, end; code points, end exclusive) by kind, then start.
    A null text is empty and has none; ids may be null or repeated. With no proposals, or with none
    of a base kind to learn from, nothing is added to the base spans.
    """
    checkpoints(docs.sparkSession)
    work = docs.select(*([F.struct(*docs.columns).alias("_row")] if keep_text else []), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at, figure = F.col("text").contains("@"), F.col("text").rlike("[0-9]")
    able = {"email": at, "ip": figure & F.col("text").rlike(r"\.[0-9]"), "card": figure, "phone": F.col("text").contains("+")}
    for kind in KINDS:
        work = _found(work, kind, PATTERNS[kind], able[kind])
        work = work.withColumn(kind, _kept(kind))
    able = {"email": at, "ip": figure & F.col("text").rlike("[.:,][0-9]"), "card": figure, "phone": figure}
    for kind in KINDS:
        work = _found(work, "_p", PROPOSALS[kind], able[kind])
        work = work.withColumn(f"_of_{kind}", _proposed(kind)).drop("_p")
    work = work.withColumn("proposed", F.concat(*[f"_of_{k}" for k in KINDS])).drop("text", *[f"_of_{k}" for k in KINDS]).checkpoint()

    # as many rows as there are combinations of features: the product of their bins at most
    apart = (F.pmod(F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")), F.lit(5)) == 0).alias("apart")
    cells = work.where(F.size("proposed") > 0).select(apart, F.explode("proposed").alias("c")).select("apart", "c.kind", *[F.col(f"c.{k}") for k in NAMES], "c.y")
    cells = cells.groupBy("apart", "kind", *NAMES).agg(F.sum("y").alias("positive"), F.sum(1 - F.col("y")).alias("negative")).orderBy("apart", "kind", *NAMES).collect()
    added = []
    for kind in KINDS:
        seen = [k for k in NAMES if k not in HIDDEN[kind]]
        table = {part: [boosting.Cell(tuple(r[k] for k in seen), r["positive"], r["negative"]) for r in cells if r["kind"] == kind and r["apart"] == part] for part in (False, True)}
        prior, trees = boosting.fit(table[False], ROUNDS) if table[False] else (0.0, [])
        least = boosting.calibrated(table[True], prior, trees, PRECISION) if trees else None
        if least is not None:
            added.append(_chosen(kind, seen, prior, trees, least))
    work = work.withColumn("base", F.concat(*KINDS))
    spans = F.transform(F.concat(*added), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))) if added else F.slice("base", F.lit(1), F.lit(0))
    work = work.withColumn("added", F.filter(spans, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    by_kind = [_with_added(k) for k in KINDS]
    work = work.withColumn("found", F.concat(*by_kind))
    return work.select(*(["_row"] if keep_text else []), "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; of overlapping spans the first one's kind."""
    found = find_personal(docs, id_col, text_col, keep_text=True)
    text = F.col(f"_row.{text_col}")
    found = found.withColumn("_spans", F.array_sort("found", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(b["end"] - a["end"])).cast("int")))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    found = found.withColumn("_cut", F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step)))
    clean = F.when(F.col("_cut").isNull(), text).otherwise(F.concat(F.array_join("_cut.out", ""), F.substring(text, (F.col("_cut.at") + 1).cast("int"), F.length(text))))
    return found.select(*[clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])

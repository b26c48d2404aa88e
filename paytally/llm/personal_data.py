"""Personal data in texts: base patterns, and boosted trees over looser candidates.

One scan cuts every text at each generator's pattern and keeps the pieces around the matches;
all else works on those narrow rows. Generators propose more than the base patterns accept:
base matches that fail their check digits or ranges, addresses with spelled-out signs, runs of
digits in telephone form. Boosted trees judge what does not overlap a base span, from its format
and its context.

There are no labels, so the trees learn from the base patterns: accepted spans are positive,
everything else is negative. Every positive is also shown in a written-around form (no plus
sign, grouped digits, "at" for @), so that the trees learn what remains of the format, and in a
broken one as a negative (wrong check digit, part out of range, date, plain words). All distinct
candidates count: three quarters of them, by a hash of their content, fit the trees, those with equal
features as one row of their number's weight, and the threshold is the lowest at which the other quarter
is accepted with ``PRECISION``. Up to ``BINS`` squared such rows, MLlib looks at every one for its splits.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytally.storage import write_once

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Most values of a feature that splits are looked for between.
BINS = 1024
#: Steps in which thresholds are tried.
STEPS = 4096
#: Code points of context kept on each side of a candidate.
CONTEXT = 24

# The base patterns. Where nothing can follow, repeats are possessive, and an
# address starts where its run of letters starts or the last one ended; this changes no match,
# and keeps the search linear on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# Looser forms.
SPELLED_EMAIL = (
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)| at ) ?"
    r"[a-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[a-z0-9-]{2,63}+){1,6}"
)
DIGIT_GROUPS = r"(?<![0-9A-Za-z.+])\(?[0-9]{2,5}\)?(?:[ .-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])"

#: Generator: kind, pattern, a cheap test that a text may hold a match, whether it is a base pattern.
GENERATORS = (
    ("email", EMAIL, lambda t: t.contains("@"), True),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), True),
    ("card", CARD, lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), True),
    ("phone", PHONE, lambda t: t.contains("+"), True),
    ("email", SPELLED_EMAIL, lambda t: t.rlike(r"(?i)@|[\[(]at[\])]| dot "), False),
    ("phone", DIGIT_GROUPS, lambda t: t.rlike(r"[0-9]{2}\)?[ .-]"), False),
)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap, match, before, after): code points since the last match, and the surroundings."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = F.arrays_zip(
        F.slice(parts, 1, F.size(found)).alias("left"), found.alias("match"), F.slice(parts, 2, F.size(found)).alias("right")
    )
    return F.transform(
        paired,
        lambda x: F.struct(
            F.length(x["left"]).alias("gap"),
            x["match"].alias("match"),
            F.right(x["left"], F.lit(CONTEXT)).alias("before"),
            F.left(x["right"], F.lit(CONTEXT)).alias("after"),
        ),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; asked of at most 19 digits."""
    each = F.reverse(F.split(F.left(digits, F.lit(19)), ""))
    weighed = F.transform(
        each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _parts_in_range(match: Column) -> Column:
    plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def _accepted(kind: Column, match: Column) -> Column:
    """Whether a base match also passes the checks of its kind."""
    n = F.length(_digits(match))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _parts_in_range(match))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(rows: DataFrame) -> DataFrame:
    """Numbers that describe the format and context of (kind, match, before, after)."""
    m, around = F.col("match"), F.concat("before", F.lit(" "), "after")
    n = F.length(_digits(m))
    words = {"mail": "mail|@", "call": "tel|phone|fax|call|mobil", "pay": "card|visa|pay|konto|credit", "net": r"\bip\b|host|server|addr"}
    columns = {
        **{f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS},
        "length": F.length(m).cast("double"),
        "digits": n.cast("double"),
        "letters": _count(m, "[A-Za-z]"),
        "dots": _count(m, r"\."),
        "spaces": _count(m, " "),
        "dashes": _count(m, "-"),
        "brackets": _count(m, r"[()\[\]]"),
        "groups": _count(m, "[0-9]+"),
        "plus": m.startswith("+").cast("double"),
        "sign": m.contains("@").cast("double"),
        "spelled": m.rlike(r"(?i)[ \[(]at[ \])]").cast("double"),
        "luhn": F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False).cast("double"),
        "small_parts": F.when(m.rlike(r"^[0-9]+(\.[0-9]+)+$"), _parts_in_range(m)).otherwise(False).cast("double"),
        "glued_before": F.col("before").rlike(r"[\p{L}0-9]$").cast("double"),
        "glued_after": F.col("after").rlike(r"^[\p{L}0-9]").cast("double"),
        "mark_before": F.col("before").rlike(r"[.,:;/=#-]$").cast("double"),
        **{f"near_{k}": around.rlike(f"(?i){p}").cast("double") for k, p in words.items()},
    }
    return rows.select("*", *(c.alias(k) for k, c in columns.items())), list(columns)


def _written_around(rows: DataFrame) -> DataFrame:
    """Accepted spans in another writing of the same data."""
    m = F.col("match")
    other = (
        F.when(F.col("kind") == "phone", F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]?", ""))
        .when(F.col("kind") == "email", F.regexp_replace(F.regexp_replace(m, "@", " at "), r"\.", " dot "))
        .when(F.col("kind") == "card", F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", "$1 "))
        .otherwise(m)
    )
    return rows.withColumn("match", other)


def _broken(rows: DataFrame) -> DataFrame:
    """Accepted spans changed so that they are no longer what they look like."""
    m, n = F.col("match"), _digits(F.col("match"))
    word = F.regexp_extract("before", r"(\p{L}+)\P{L}*$", 1)
    after = F.regexp_extract("after", r"^\P{L}*(\p{L}+)", 1)
    last = (F.right(n, F.lit(1)).cast("int") + 3) % 10
    other = (
        F.when(F.col("kind") == "phone", F.concat(F.substring(n, 1, 4), F.lit("-"), F.substring(n, 5, 2), F.lit("-"), F.substring(n, 7, 2)))
        .when(F.col("kind") == "email", F.concat(word, F.lit(" at "), after, F.lit(". "), word))
        .when(F.col("kind") == "card", F.regexp_replace(m, "[0-9]$", last.cast("string")))
        .otherwise(F.concat(F.lit("9"), F.left(n, F.lit(2)), F.regexp_extract(m, r"\..*$", 0)))
    )
    return rows.withColumn("match", other)


def _fit(candidates: DataFrame, sample: int | None = None):
    """(model, assembler, threshold) of the boosted trees, or None where one of the classes has no case.

    All cases count, unless the caller asks for a ``sample`` of so many.
    """
    base = candidates.where("accepted")
    cases = candidates.select("kind", "match", "before", "after", F.col("accepted").cast("double").alias("label")).union(
        _written_around(base).select("kind", "match", "before", "after", F.lit(1.0).alias("label"))
    ).union(_broken(base).select("kind", "match", "before", "after", F.lit(0.0).alias("label")))
    cases = cases.distinct()  # copies of a text are one case
    key = F.xxhash64("kind", "match", "before", "after", "label")
    cases = cases.withColumn("key", key)
    if sample is not None:
        cases = cases.orderBy("key", "match", "before", "after").limit(sample)
    described, names = features(cases.withColumn("held", F.abs(F.col("key")) % 4 == 0))
    weighed = described.groupBy("held", "label", *names).agg(F.count("*").cast("double").alias("weight"))
    chosen = write_once(weighed.orderBy("held", "label", *names), "cases")
    if chosen.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    cases = assembler.transform(chosen)
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=BINS)
    if cases.where("not held").agg(F.count_distinct("label")).first()[0] < 2:
        return None
    model = trees.fit(cases.where("not held"))
    scored = model.transform(cases.where("held")).select(vector_to_array("probability")[1].alias("p"), "label", "weight")
    steps = scored.groupBy(F.floor(F.col("p") * STEPS).alias("step")).agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("right")
    ).orderBy(F.desc("step")).collect()  # a row for each step at most
    threshold, right, n = 1.01, 0.0, 0.0
    for i, step in enumerate(steps, 1):
        right, n = right + step["right"], n + step["n"]
        below = steps[i]["high"] if i < len(steps) else 0.0
        if below < step["low"] and right / n >= PRECISION:
            threshold = (step["low"] + below) / 2
    return model, assembler, max(threshold, 0.5)


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and the candidates (row, kind, start, end, match, ..., accepted)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast("array<struct<gap:int,match:string,before:string,after:string>>")
    found = write_once(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.md5(text.cast("binary")).alias("digest"),
            *(F.when(test(text), _matches(text, pattern)).otherwise(nothing).alias(f"g{k}") for k, (_, pattern, test, _) in enumerate(GENERATORS)),
        ),
        "matches",
    )
    rows = None
    for k, (kind, _, _, base) in enumerate(GENERATORS):
        own = found.where(F.size(f"g{k}") > 0).select(
            "row", F.lit(k).alias("generator"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.posexplode(f"g{k}").alias("place", "m")
        )
        rows = own if rows is None else rows.union(own)
    up_to = Window.partitionBy("row", "generator").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.match")
    end = F.sum(F.col("m.gap") + size).over(up_to)
    spans = rows.select(
        "row", "kind", "base", (end - size).cast("long").alias("start"), end.cast("long").alias("end"), "m.match", "m.before", "m.after"
    )
    accepted = F.col("base") & _accepted(F.col("kind"), F.col("match"))
    # A looser generator may propose what a base pattern found as well: one row for each span.
    spans = spans.withColumn("accepted", accepted).groupBy("row", "kind", "start", "end").agg(
        F.max("accepted").alias("accepted"), F.first("match").alias("match"), F.first("before").alias("before"), F.first("after").alias("after")
    )
    return found.select("row", "doc_id", "digest"), write_once(spans, "candidates")


def find_spans(docs: DataFrame, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, digest) of all of ``docs(doc_id, text)``, and their spans (row, kind, start, end, base, score).

    Offsets count code points, the end is exclusive. ``base`` spans are those of the base
    patterns and always kept; the others are candidates that overlap no base span and score at
    least the threshold. ``digest`` is the MD5 of the text. A null text is an empty one.
    """
    rows, candidates = _spans(docs)
    taken = candidates.where("accepted").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    loose = candidates.join(taken, "row", "left").where(
        ~F.col("accepted") & ~F.coalesce(F.exists("taken", lambda t: (t["start"] < F.col("end")) & (F.col("start") < t["end"])), F.lit(False))
    ).drop("taken")
    loose = write_once(loose, "loose")
    base = candidates.where("accepted").select("row", "kind", "start", "end", F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    fitted = _fit(candidates.where("accepted").unionByName(loose), sample)
    if fitted is None:
        return rows, base
    model, assembler, threshold = fitted
    described, _ = features(loose)
    scored = model.transform(assembler.transform(described)).withColumn("score", vector_to_array("probability")[1])
    added = scored.where(F.col("score") >= threshold).select("row", "kind", "start", "end", F.lit(False).alias("base"), "score")
    return rows, write_once(base.union(added), "spans")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base counts by kind, base_sha256, spans.

    Rows that repeat are reported each; a null doc_id stays null; other columns are not looked
    at; an empty table gives no rows.
    """
    rows, spans = find_spans(docs, sample)
    entry = F.struct(F.col("start"), _rank(F.col("kind")).alias("rank"), F.col("end"), F.col("kind"))
    by_row = spans.groupBy("row").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        F.collect_list(F.when(F.col("base"), entry)).alias("base_spans"),
        F.collect_list(entry).alias("all_spans"),
    )
    joined = rows.join(by_row, "row", "left")
    text = F.coalesce(_joined(F.col("base_spans")), F.lit(""))
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(text.cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all_spans")), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    Columns other than text are kept as they are, as are null texts.
    """
    rows, spans = find_spans(docs, sample)
    entry = F.struct(F.col("start"), F.col("end"), F.col("kind"))
    per_text = (
        rows.where("digest is not null")
        .join(spans.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("cuts")), "row")
        .groupBy("digest")  # equal texts have equal spans
        .agg(F.first("cuts").alias("cuts"))
    )
    text = F.col("row.text")
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("done"))

    def step(state: Column, cut: Column) -> Column:
        start, end = cut["start"], cut["end"]
        fresh = F.concat(
            state["text"],
            F.substring(text, (state["done"] + 1).cast("int"), (start - state["done"]).cast("int")),
            F.concat(F.lit("["), F.upper(cut["kind"]), F.lit("]")),
        )
        return F.struct(
            F.when(start >= state["done"], fresh).otherwise(state["text"]).alias("text"),
            F.greatest(end, state["done"]).alias("done"),
        )

    def finish(state: Column) -> Column:
        return F.concat(state["text"], F.substring(text, (state["done"] + 1).cast("int"), F.length(text)))

    # Rows whole in one column, so that no name of theirs meets one of ours.
    keyed = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"))
    cleaned = F.when(F.col("cuts").isNull(), text).otherwise(F.aggregate("cuts", empty, step, finish))
    return keyed.join(per_text, "digest", "left").select(
        *((cleaned if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )

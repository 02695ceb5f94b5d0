"""Personal data in whole texts: fixed patterns, widened by boosted trees over candidates. DataFrame expressions only.

Base spans follow fixed patterns. Generators with a high recall propose wider, overlapping candidates of each kind. Trees
judge a candidate by format and context; they learn from every document: a candidate that overlaps a base
span of its kind is positive, and never see the very mark that makes it one (the plus of a phone number, the check
sum, ...). Negative are known failures alone: a span of another kind, a failed check sum, a number out of range, the cue of a
version or page. What looks like personal data without the mark is unlabelled and takes no part, however common it is.
A threshold is calibrated on the quarter of the documents not learned from. Candidates above it that overlap no base span are added.

A match travels as a row with its surroundings, never with the text, and its place is a running sum over one document's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm import boosting
from panelweave.llm.common import stage

#: The kinds in the order in which they are listed, with their patterns. Each finds the same matches as the plain
#: pattern of the kind; possessive repeats and a start at the edge of a run keep them linear on texts of any form.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators.
WIDE = {
    "email": r"(?<![\w.%+-])[\w.%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[\w-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\w-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:[.,:][0-9]++){3,8}+",
    "card": r"[0-9](?:[\x20./-]{0,2}[0-9])++",
    "phone": r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])++",
}
#: Words before a number that tell its kind.
CUES = {
    1: r"(?i)(?:mail|e-mail|contact|write)\W*$",
    2: r"(?i)(?:\bip|server|host|address|port)\W*$",
    3: r"(?i)(?:card|visa|account|payment|credit)\W*$",
    4: r"(?i)(?:tel|phone|call|mobile|fax|cell)\W*$",
    5: r"(?i)(?:version|license|id|no|nr|page|section)\W*$",
}
FEATURES = ["n_chars", "n_digits", "n_groups", "longest_group", "n_dots", "n_dashes", "n_spaces", "n_brackets", "n_letters", "cue", "edge_before", "edge_after"]
#: Precision and positives that a threshold needs; characters of context.
PRECISION, LEAST, CONTEXT = 0.99, 20, 24
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check sum of a string of 12 to 19 digits."""
    reverse = F.reverse(number)
    value = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(reverse, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda total, v: total + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    n = F.length(digits(match))
    if kind == "ip":
        plain = F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", "")
        return plain.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def fails(kind: Column, match: Column) -> Column:
    """Whether a wide candidate cannot be of its kind: a check sum, an octet, a number of digits or of parts that is wrong."""
    n, parts = F.length(digits(match)), F.split(match, "[^0-9]+", -1)
    large = F.exists(parts, lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike(rf"^(?!{_OCTET}$)[0-9]"))
    return (F.when(kind == "ip", (F.size(parts) != 4) | large)
            .when(kind == "card", F.when(n.between(12, 19), ~luhn(digits(match))).otherwise(True))
            .when(kind == "phone", ~n.between(9, 15)).otherwise(False))


def matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A row per match: the key columns, ``kind``, ``start``, ``end`` (code points), ``match``, text before and after."""
    def found(kind: str) -> Column:
        text = F.col("text")
        parts, hits = F.split(text, patterns[kind], -1), F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(0))
        both = F.transform(F.array(F.struct(parts.alias("p"), hits.alias("m"))), lambda b: F.when(F.size(b["m"]) > 0, F.transform(
            F.sequence(F.lit(1), F.size(b["m"])), lambda i: F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(F.element_at(b["p"], i)).alias("gap"), F.element_at(b["m"], i).alias("match"),
                F.right(F.element_at(b["p"], i), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(b["p"], i + 1), F.lit(1)).alias("after")))))
        needed = text.rlike(r"@|[\[(]at[\])]") if "email" in kind else text.rlike("[0-9]")
        return F.when(needed, F.element_at(both, 1))

    nothing = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,before:string,after:string>>")
    each = rows.select("key", "id", F.explode(F.concat(*[F.coalesce(found(k), nothing) for k in patterns])).alias("f")).select("key", "id", "f.*")
    each = each.dropDuplicates(["key", "kind", "i"])  # of equal rows
    ends = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("key", "kind").orderBy("i"))
    return (each.withColumn("end", ends).withColumn("start", F.col("end") - F.length("match")).drop("gap", "i"))


def with_features(found: DataFrame) -> DataFrame:
    """Format and context of each match as small whole numbers."""
    match, number = F.col("match"), digits(F.col("match"))
    count = lambda pattern: F.regexp_count(match, F.lit(pattern))
    cue = F.lit(0)
    for value, pattern in CUES.items():
        cue = F.when(F.col("before").rlike(pattern), value).otherwise(cue)
    return found.select(
        "*", F.least(F.length(match), F.lit(64)).alias("n_chars"), F.least(F.length(number), F.lit(32)).alias("n_digits"), F.least(count("[0-9]++"), F.lit(12)).alias("n_groups"),
        F.least(F.array_max(F.transform(F.split(match, "[^0-9]+", -1), F.length)), F.lit(32)).alias("longest_group"), F.least(count(r"\."), F.lit(8)).alias("n_dots"),
        F.least(count("-"), F.lit(8)).alias("n_dashes"), F.least(count(r"\x20"), F.lit(8)).alias("n_spaces"), F.least(count("[()]"), F.lit(4)).alias("n_brackets"),
        F.least(count("[A-Za-z]"), F.lit(32)).alias("n_letters"), cue.alias("cue"),
        F.when(F.col("before").rlike(r"[\w+@]$"), 1).otherwise(0).alias("edge_before"), F.when(F.col("after").rlike(r"^[\w@]"), 1).otherwise(0).alias("edge_after"))


def touched(spans: DataFrame, is_mark: Column, mark_kind: Column | None = None) -> Column:
    """Whether a row overlaps a marked row of its document (of its kind): both neighbours in the order of places are enough."""
    keys = ["key"] if mark_kind is None else ["key", mark_kind]
    before = Window.partitionBy(*keys).orderBy("start", "end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.coalesce(F.max(F.when(is_mark, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(is_mark, F.col("start"))).over(after) < F.col("end"), F.lit(False))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All matches of all patterns: base spans that hold (``base``), and wide candidates with features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.col("text").rlike(r"[0-9@]|[\[(]at[\])]"))
    # Equal rows have equal spans, so the content names a document, with or without an id.
    rows = rows.select(F.struct("id", F.xxhash64("text").alias("text"), F.length("text").alias("n")).alias("key"), "id", "text")
    found = stage(matches(rows, {**BASE, **{f"wide {k}": p for k, p in WIDE.items()}}), "pii-matches")
    wide = F.col("kind").startswith("wide ")
    kind = F.when(wide, F.substring("kind", 6, 9)).otherwise(F.col("kind"))
    valid = F.lit(False)
    for name in BASE:
        valid = F.when(F.col("kind") == name, holds(name, F.col("match"))).otherwise(valid)
    found = found.select("key", "id", "start", "end", "match", "before", "after", wide.alias("wide"), (~wide & valid).alias("base"), kind.alias("kind"))
    return found.filter("base or wide")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> dict[str, tuple[list[boosting.Node], float]]:
    """Trees and threshold of each kind, from all documents; ``found`` are their matches by :func:`spans_of`, if at hand.

    Learned from are candidates that overlap a base span of their kind, and known failures. They are counted by pattern of
    features, small numbers with a limit each, before anything reaches the driver. A kind without enough positives among
    the documents held back gets an infinite threshold, so nothing is added for it.
    """
    found = spans_of(docs, id_col, text_col) if found is None else found
    marked = (found.withColumn("y", touched(found, F.col("base"), F.col("kind")).cast("int"))
              .withColumn("_known", touched(found, F.col("base"))).filter("wide"))
    fold = (F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(4)) == 0).alias("held")
    known = with_features(marked).filter((F.col("y") == 1) | F.col("_known") | fails(F.col("kind"), F.col("match")) | (F.col("cue") == 5))
    counted = known.groupBy("kind", fold, *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    rows = sorted((r.asDict() for r in counted), key=lambda r: tuple(str(r[c]) for c in ("kind", *FEATURES)))
    model = {}
    for kind in BASE:
        trees = boosting.fit([r for r in rows if r["kind"] == kind and not r["held"]], FEATURES)
        model[kind] = (trees, boosting.threshold(trees, [r for r in rows if r["kind"] == kind and r["held"]], PRECISION, LEAST))
    return model


def find(docs: DataFrame, model: dict[str, tuple[list[boosting.Node], float]], id_col: str = "doc_id", text_col: str = "text",
         found: DataFrame | None = None) -> DataFrame:
    """One row per span: ``key``, ``id``, ``kind``, ``start``, ``end``, ``match``, ``base``, ``score``.

    All base spans, and the candidates over their kind's threshold that overlap no base span; of added spans that
    overlap each other the first stays, then the next that does not overlap one that stays.
    """
    scored = with_features(spans_of(docs, id_col, text_col) if found is None else found)
    score, enough = F.lit(None).cast("double"), F.lit(False)
    for kind, (trees, least) in model.items():
        score = F.when(F.col("kind") == kind, boosting.margin_column(trees)).otherwise(score)
        enough = F.when(F.col("kind") == kind, boosting.margin_column(trees) >= least if least != float("inf") else F.lit(False)).otherwise(enough)
    scored = scored.withColumn("score", score).filter(F.col("base") | enough)
    free = scored.withColumn("_hit", touched(scored, F.col("base"))).filter(F.col("base") | ~F.col("_hit"))
    # Added spans that hang together by overlaps form a cluster, a few spans of one place in a text; inside it the choice is greedy.
    place = Window.partitionBy("key").orderBy("start", F.desc("end"), "kind")
    added = free.filter(~F.col("base"))
    opens = F.coalesce(F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    clusters = added.withColumn("_cluster", F.sum(opens.cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("start", (-F.col("end")).alias("_back"), "kind", "end", "id", "match", "score")
    chosen = F.aggregate(
        F.array_sort(F.collect_list(span)), F.array().cast(f"array<{clusters.select(span.alias('s')).schema['s'].dataType.simpleString()}>"),
        lambda kept, s: F.when((F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))
    taken = clusters.groupBy("key", "_cluster").agg(chosen.alias("_s")).select("key", F.explode("_s").alias("s"))
    rest = taken.select("key", "s.id", "s.kind", "s.start", "s.end", "s.match", F.lit(False).alias("base"), "s.score")
    return free.filter("base").select("key", "id", "kind", "start", "end", "match", "base", "score").unionByName(rest)


def pii(docs: DataFrame, model: dict[str, tuple[list[boosting.Node], float]], id_col: str = "doc_id", text_col: str = "text",
        found: DataFrame | None = None) -> DataFrame:
    """One row per document: the id, counts of base spans by kind, ``base_sha256`` of the base spans, ``spans`` of all.

    Spans are written ``kind:start:end`` by start, then kind as listed, with commas between; places are code points. NULL
    and empty texts have none. Rows that repeat an id and text get the same answer each; other columns are not read.
    An empty table gives an empty result. ``found`` are the documents' matches by :func:`spans_of`, if at hand.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in BASE]), F.col("kind"))
    span = F.struct("start", order.alias("order"), "end", F.concat_ws(":", "kind", "start", "end").alias("label"))
    joined = lambda each: F.array_join(F.transform(F.array_sort(each), lambda s: s["label"]), ",")
    spans = find(docs, model, id_col, text_col, found).groupBy("key").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE],
        joined(F.collect_list(F.when(F.col("base"), span))).alias("_base"), joined(F.collect_list(span)).alias("_all"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"), F.length(text).alias("n")).alias("_key"))
    result = every.join(spans, F.col("_key").eqNullSafe(F.col("key")), "left")
    return result.select(id_col, *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE],
                         F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"))

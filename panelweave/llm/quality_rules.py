"""Quality rules as learned decision lists: DataFrame expressions only.

Statistics of whole texts are column expressions. From the statistics of labelled documents, sequential covering grows
threshold conjunctions that single out bad documents, prunes them on other rows and keeps those that stay precise. The
list comes out as one ordered conditional expression that anyone can read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import sample_share

#: Words of a repeated window; expected labelled rows learned from.
WINDOW, MAX_ROWS = 8, 20_000
#: Most conditions of a rule, so that it can be read; the number of rules and the thresholds are not bounded.
MAX_CONDITIONS = 4
#: Share of bad rows that a pruned rule must reach on rows it was not grown on, and rows it must cover there.
PRECISION, LEAST_ROWS = 0.97, 3

WHITE = r"[\x20\x09-\x0D]+"
#: The statistics that rules may use.
SHARES = ["n_words", "word_length", "symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share"]


def words(text: Column) -> Column:
    """The runs of characters other than ``[\\x20\\x09-\\x0D]``."""
    return F.array_remove(F.split(text, WHITE, -1), "")


def repeat_words(tokens: Column) -> Column:
    """Words of an array that lie in a window of ``WINDOW`` words found twice or more; windows are compared whole."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    numbers = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    exact = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(tokens, i, WINDOW), " ").alias("w"), i.alias("i"))))

    def same(sorted_windows: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:  # k from 0
            before = F.when(k > 0, F.element_at(sorted_windows, F.greatest(k, F.lit(1)))["w"] == x["w"]).otherwise(False)
            after = F.when(k + 1 < F.size(sorted_windows), F.element_at(sorted_windows, F.least(k + 2, F.size(sorted_windows)))["w"] == x["w"]).otherwise(False)
            return before | after

        return F.array_sort(F.transform(F.filter(sorted_windows, repeated), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(places) == 0, 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda total, g: total + g))

    once = F.transform(F.array(exact), same)  # a one-element array binds a value that is used more than once
    total = F.element_at(F.transform(once, covered), 1)
    clean = F.element_at(F.transform(F.array(numbers), lambda x: F.size(F.array_distinct(x)) == F.size(x)), 1)
    return F.when(n < WINDOW + 1, 0).when(clean, 0).otherwise(total).cast("long")


def statistics(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """The counts of each whole text and the shares that rules use; NULL has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"), words(text).alias("_words"),
                        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    counted = first.select(
        "doc_id", *keep, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))).alias("_upper"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).alias("_marks"))
    word = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("word_chars") / word).alias("word_length"),
        (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("_marks") / chars).alias("mark_share"), (F.col("_upper") / chars).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / word).alias("repeat_share"))


@dataclass(frozen=True)
class Condition:
    """A statistic at least (or below) a threshold."""

    name: str
    at_least: bool
    value: float

    def column(self) -> Column:
        return F.col(self.name) >= self.value if self.at_least else F.col(self.name) < self.value

    def holds(self, row: dict) -> bool:
        return (row[self.name] >= self.value) == self.at_least


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def precision(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    """Smoothed share of bad rows among those covered, and how many those are."""
    bad = [row["bad"] for row in rows if covers(rule, row)]
    return (sum(bad) + 1) / (len(bad) + 2), len(bad)


def grow(rows: list[dict]) -> Rule:
    """Add the condition with the largest gain in information about bad rows until no good row is left.

    Thresholds are the midpoints between neighbouring values at which the share of bad rows changes; no other can gain more.
    """
    from math import log2

    rule: Rule = ()
    inside = rows
    while len(rule) < MAX_CONDITIONS and any(not r["bad"] for r in inside) and any(r["bad"] for r in inside):
        bad, size = sum(r["bad"] for r in inside), len(inside)
        best, gain = None, 1e-9
        for name in SHARES:
            seen: dict[float, list[int]] = {}
            for r in inside:
                at = seen.setdefault(r[name], [0, 0])
                at[0] += 1
                at[1] += r["bad"]
            values = sorted(seen)
            below = below_bad = 0
            for low, high in zip(values, values[1:]):
                (n_low, bad_low), (n_high, bad_high) = seen[low], seen[high]
                below, below_bad = below + n_low, below_bad + bad_low
                if bad_low * n_high == bad_high * n_low:
                    continue
                value = low + (high - low) / 2
                value = value if value > low else high
                for at_least, p, n in ((True, bad - below_bad, size - below), (False, below_bad, below)):
                    if p and n < size:
                        found = p * (log2(p / n) - log2(bad / size))
                        if found > gain:
                            best, gain = Condition(name, at_least, value), found
        if best is None:
            break
        rule += (best,)
        inside = [r for r in inside if best.holds(r)]
    return rule


def prune(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule that is most precise on rows it was not grown on; of equals the shortest."""
    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (round(precision(r, rows)[0], 9), -len(r)))


def learn_list(rows: list[dict]) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, drop what is covered, until a rule is not precise."""
    rules: list[Rule] = []
    left = rows
    while any(r["bad"] for r in left):  # every rule covers some of the rows left
        growing, pruning = [r for r in left if r["fold"] < 2], [r for r in left if r["fold"] == 2]
        rule = grow(growing)
        if not rule:
            break
        rule = prune(rule, pruning)
        share, size = precision(rule, pruning)
        grown, n = precision(rule, growing)
        if size < LEAST_ROWS or (share * (size + 2) - 1) / size < PRECISION or grown < PRECISION and n > 1 / (1 - PRECISION):
            break
        rules.append(rule)
        left = [r for r in left if not covers(rule, r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules for documents that ``labels`` (id, 1 good, 0 bad) marks as bad.

    ``max_rows`` bounds the expected number of rows learned from: beyond it a fixed share of the ids takes part, and
    their statistics alone reach the driver. Rows without label are left out; several labels of an id count as their
    smallest. Without bad rows there are no rules.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    total = marked.count()
    if total > max_rows:
        marked = marked.filter(sample_share(F.col("_id"), F.lit(max_rows / total)))
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_whole")).join(F.broadcast(marked), F.col("_doc") == F.col("_id"))  # about max_rows small rows
    rows = statistics(joined, "_doc", "_whole", "_label").select(*SHARES, (F.col("_label") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold"), "doc_id")
    return learn_list([r.asDict() for r in rows.orderBy("doc_id").collect()])


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the first rule that covers a document rejects it."""
    out = F.lit(True)
    for rule in reversed(rules):
        condition = rule[0].column()
        for part in rule[1:]:
            condition = condition & part.column()
        out = F.when(condition, False).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the counts of its words, ``base_failed`` and ``kept``.

    A document fails the base when it has fewer than 20 words or over 30 in 100 of them in repeated windows; else the list
    decides. NULL, empty and blank texts have no words and fail. Every row is judged by itself; other columns are
    not read. An empty table gives an empty result.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = statistics(docs, id_col, text_col)
    return counted.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                          F.when(failed, False).otherwise(verdict(rules)).alias("kept"))

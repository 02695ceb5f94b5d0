"""Mixing to target weights with soft membership. DataFrame expressions only.

A classifier learned from a labelled table gives every document posterior probabilities of the domains. Each document gets
a nonnegative rate such that the expected tokens of the domains (rate times tokens times posterior, summed) come as close to
the targets as they can in the least-squares sense. The rates are found by projected gradient: all start at 1, a step moves
each down the gradient and cuts it off at the bounds. With lengths measured in tokens and misses over the domains' tokens, a
step of length 1 never overshoots; longer ones follow from how much the last step bent the slope (spectral step lengths) and
are taken back where they raise the squares. A step is one aggregation over all documents; the driver sees one total per
domain, and a document's rate is a fold over the steps' few numbers.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import sample_share, stage
from panelweave.llm.quality_rules import words

#: Expected labelled rows learned from; bins per statistic; cue words per domain; largest weight of one cue word.
MAX_ROWS, BINS, CUE_WORDS, CUE_LIMIT = 20_000, 8, 40, 6.0
#: Most steps; the relative miss at which they end; the share of the squares by which unreachable targets may exceed the least.
STEPS, CLOSE, SETTLED = 150, 1e-4, 1e-4
#: At the edge of what can be reached steps gain little: after ``PATIENCE`` of them, totals proved within ``NEARLY`` of the least
#: squares (as a share of all tokens) will do.
PATIENCE, NEARLY = 40, 1e-3
#: Steps after which the rates are written down, so that a step replays no more than these; steps that a longer one is judged by.
REPLAYED, JUDGED = 16, 8
STATISTICS = ["log_words", "word_length", "symbol_share", "mark_share", "upper_share", "distinct_share"]


@dataclass(frozen=True)
class Domains:
    """Naive Bayes over binned statistics and cue words: everything is a logarithm of a probability or a ratio."""

    names: tuple[str, ...]
    prior: tuple[float, ...]
    cuts: dict[str, tuple[float, ...]]
    bins: dict[str, tuple[tuple[float, ...], ...]]  # statistic -> bin -> domain
    cues: dict[str, tuple[float, ...]]  # word -> domain


def statistics(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Tokens (words) of whole texts, light statistics and the distinct lower-case words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"), words(text).alias("_words"))
    chars = F.greatest(F.length(F.array_join("_words", "")), F.lit(1))
    return first.select(
        "doc_id", *keep, F.size("_words").cast("long").alias("n_tokens"), F.log1p(F.size("_words")).alias("log_words"),
        (F.size(F.array_distinct("_words")) / F.sqrt(F.greatest(F.size("_words"), F.lit(1)))).alias("distinct_share"),
        (chars / F.greatest(F.size("_words"), F.lit(1))).alias("word_length"), (F.regexp_count("_text", F.lit(r"[#*$%&|<>]")) / chars).alias("symbol_share"),
        ((F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))) / chars).alias("mark_share"),
        ((F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))) / chars).alias("upper_share"), words(F.lower("_text")).alias("_lower"))


def bin_of(name: str, cuts: tuple[float, ...]) -> Column:
    out = F.lit(len(cuts))
    for number in reversed(range(len(cuts))):
        out = F.when(F.col(name) < cuts[number], number).otherwise(out)
    return out


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
                max_rows: int = MAX_ROWS) -> Domains:
    """Learn the domains of ``labelled`` (id, domain) from the texts of ``docs``.

    ``max_rows`` bounds the expected number of labelled rows learned from. Rows without id or domain are left out; of several
    domains of an id the first by name counts. The driver gets counts by bin and the cue words, not the rows.
    """
    marked = labelled.filter(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(domain_col).cast("string")).alias("_domain"))
    total = marked.count()
    if total > max_rows:
        marked = marked.filter(sample_share(F.col("_id"), F.lit(max_rows / total)))
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_whole")).join(F.broadcast(marked), F.col("_doc") == F.col("_id"))  # about max_rows small rows
    rows = stage(statistics(joined, "_doc", "_whole", "_domain"), "mixing-rows")
    sizes = {r["_domain"]: r["n"] for r in rows.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = tuple(sorted(sizes))
    n = sum(sizes.values())
    prior = tuple(log(sizes[k] / n) for k in names)
    quantiles = [i / BINS for i in range(1, BINS)]
    # Many values are exactly 0: they are a bin of their own.
    found = rows.agg(*[F.percentile_approx(F.when(F.col(s) > 0, F.col(s)), quantiles, 10_000).alias(s) for s in STATISTICS]).first() if n else {}
    cuts = {s: tuple(sorted({1e-12, *(found[s] or ())})) for s in STATISTICS} if n else {}
    bins = {}
    for s in cuts:
        seen = {(r["b"], r["_domain"]): r["n"] for r in rows.groupBy(bin_of(s, cuts[s]).alias("b"), "_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
        width = len(cuts[s]) + 1
        bins[s] = tuple(tuple(log((seen.get((b, k), 0) + 0.5) / (sizes[k] + 0.5 * width)) for k in names) for b in range(width))
    each = rows.select("_domain", F.explode(F.array_distinct("_lower")).alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("_domain") == k).alias(f"n{i}") for i, k in enumerate(names)], F.count(F.lit(1)).alias("n")) if names else None
    cues: dict[str, tuple[float, ...]] = {}
    for i, k in enumerate(names):
        ratio = F.log(((F.col(f"n{i}") + 0.5) / (sizes[k] + 1)) / ((F.col("n") - F.col(f"n{i}") + 0.5) / (n - sizes[k] + 1)))
        sure = F.col("ratio") / F.sqrt(1 / (F.col(f"n{i}") + 0.5) + 1 / (F.col("n") - F.col(f"n{i}") + 0.5))  # in standard errors
        best = each.withColumn("ratio", ratio).withColumn("sure", sure).filter((F.col("ratio") > 1) & (F.col("sure") > 3.5)).orderBy(F.desc("sure"), "word").limit(CUE_WORDS)
        for r in best.collect():
            shares = [min(0.999, (r[f"n{j}"] + 0.5) / (sizes[m] + 1)) for j, m in enumerate(names)]
            top = max(log(s) for s in shares)
            cues[r["word"]] = tuple(max(-CUE_LIMIT, log(s) - top) for s in shares)
    return Domains(names, prior, cuts, bins, cues)


def added(found: str, table: Column) -> Column:
    """The sum of the words' values in a table."""
    return F.aggregate(found, F.lit(0.0), lambda total, word: total + F.element_at(table, word))


def with_posteriors(docs: DataFrame, domains: Domains, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``doc_id``, columns to keep, ``n_tokens`` and ``posterior``, an array by domain name in order."""
    counted = statistics(docs, id_col, text_col, *keep)
    for s, cuts in domains.cuts.items():
        counted = counted.withColumn(f"_{s}", bin_of(s, cuts))
    met = F.array_intersect("_lower", F.array(*[F.lit(w) for w in domains.cues]).cast("array<string>"))
    counted = counted.withColumn("_met", met)
    logs = []
    for i in range(len(domains.names)):
        total = F.lit(domains.prior[i])
        for s, table in domains.bins.items():
            total = total + F.element_at(F.array(*[F.lit(row[i]) for row in table]), F.col(f"_{s}") + 1)
        for_word = F.map_from_arrays(F.array(*[F.lit(w) for w in domains.cues]), F.array(*[F.lit(v[i]) for v in domains.cues.values()])) if domains.cues else None
        logs.append(total if for_word is None else total + added("_met", for_word))
    shares = counted.select("doc_id", *keep, "n_tokens", F.array(*logs).alias("_logs")).withColumn("_e", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))))
    whole = F.aggregate("_e", F.lit(0.0), lambda t, x: t + x)
    return shares.select("doc_id", *keep, "n_tokens", F.transform("_e", lambda x: x / whole).alias("posterior"))


@dataclass(frozen=True)
class Rates:
    """The steps from rate 1, one number per domain each. ``misses`` of the totals are relative.

    ``settled`` says that the misses are below ``CLOSE`` or proved to be the least squares.
    """

    history: tuple[tuple[float, ...], ...]
    misses: tuple[float, ...]
    settled: bool = True

    @property
    def steps(self) -> int:
        return len(self.history)

    @property
    def reached(self) -> bool:
        return max(map(abs, self.misses), default=0.0) < CLOSE


def _first_rate(most: float | None) -> Column:
    return F.lit(1.0 if most is None else min(1.0, float(most)))


def _stepped(rate: Column, history: Sequence[tuple[float, ...]], most: float | None) -> Column:
    """The rate after the steps of ``history``."""
    if not history:
        return rate
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in moves]) for moves in history])

    def step(now: Column, moves: Column) -> Column:
        for k in range(len(history[0])):
            now = now - F.get("posterior", F.lit(k)) * F.get(moves, F.lit(k))
        lowered = F.greatest(now, F.lit(0.0))
        return lowered if most is None else F.least(lowered, F.lit(float(most)))

    return F.aggregate(steps, rate, step)


def pulled(shares: Sequence[Column], at: Sequence[float]) -> Column:
    """The sum of ``shares`` times ``at``. The numbers go along as data: written into the expression, they would make Spark
    compile new code for every step, on the driver and on every executor.
    """
    products = F.zip_with(F.array(*shares), F.array(*[F.lit(float(v)) for v in at]), lambda x, v: x * v)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def rate_column(fitted: Rates, most: float | None) -> Column:
    """A document's rate."""
    return _stepped(_first_rate(most), fitted.history, most)


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None, steps: int = STEPS) -> Rates:
    """Rates from 0 to ``most`` whose domain totals meet ``targets``, or miss them least (squares, each over its domain's tokens).

    ``members`` has ``n_tokens`` and ``posterior`` and is read once per step. A miss is relative to the target or to the domain's
    tokens, whichever is smaller. The search ends when all are below ``CLOSE``. Where targets cannot be met, it ends when the
    dual bound proves the squares within ``SETTLED`` of the least, as a share, or after ``PATIENCE`` steps the totals within
    ``NEARLY`` of theirs. After ``steps`` steps it ends unsettled; ``misses`` tell by how much the totals miss in every case.
    """
    size = len(targets)
    if not size:
        return Rates((), ())
    wanted = np.array(targets, float)
    p = [F.coalesce(F.get("posterior", F.lit(k)), F.lit(0.0)) for k in range(size)]
    tokens = F.col("n_tokens")
    states = members.select("n_tokens", "posterior", _first_rate(most).alias("rate"))
    row = states.agg(*[F.sum(tokens * x) for x in p], *[F.sum(tokens * F.col("rate") * x) for x in p]).first()
    mass, now = (np.array([float(v or 0) for v in part]) for part in (row[:size], row[size:]))
    live = mass > 0  # a domain without tokens has no total to move
    weight = np.where(live, mass, 1.0)
    scale = np.where(live, np.where(wanted > 0, np.minimum(mass, wanted), mass), np.where(wanted > 0, wanted, 1.0))

    def pull(totals: np.ndarray) -> np.ndarray:
        return np.where(live, (totals - wanted) / weight, 0.0)

    def squares(totals: np.ndarray) -> float:
        return float((mass * pull(totals) ** 2).sum() / 2)

    def least(at: np.ndarray, lowest: float, bounded: float) -> float:
        """What the squares cannot fall below, by the dual at ``at``."""
        if most is not None:
            return bounded * most - float(at @ np.where(live, wanted, 0.0)) - float((mass * at * at).sum() / 2)
        raised = np.where(live, at + max(0.0, -lowest), 0.0)  # posteriors sum to 1: no document pulls below 0 now
        first, second = -float(raised @ wanted), float((mass * raised * raised).sum())
        return max(0.0, first) ** 2 / (2 * second) if second else 0.0

    history: list[tuple[float, ...]] = []
    recent: list[tuple[float, ...]] = []
    seen, length = [squares(now)], 1.0
    for taken in range(steps):
        if np.abs(((now - wanted) / scale)[live]).max(initial=0.0) < CLOSE:
            break
        if len(recent) == REPLAYED:
            states = stage(states.select("n_tokens", "posterior", _stepped(F.col("rate"), recent, most).alias("rate")), "mixing-rates")
            recent = []
        at = pull(now)
        moves = tuple((length * at).tolist())
        before = states.select("n_tokens", "posterior", _stepped(F.col("rate"), recent, most).alias("old"))
        found = before.select("n_tokens", "posterior", "old", _stepped(F.col("old"), [moves], most).alias("new"), pulled(p, at.tolist()).alias("slope"))
        row = found.agg(*[F.sum(tokens * F.col("new") * x) for x in p], F.sum(tokens * (F.col("new") - F.col("old")) ** 2),
                        F.min(F.when(tokens > 0, F.col("slope"))), F.sum(tokens * F.least(F.col("slope"), F.lit(0.0)))).first()
        *after, moved, lowest, bounded = [float(v or 0) for v in row]
        gap = seen[-1] - least(at, lowest, bounded)
        if gap < SETTLED * seen[-1] or taken >= PATIENCE and 2 * gap < NEARLY ** 2 * mass.sum():
            return Rates(tuple(history), tuple(((now - wanted) / scale).tolist()))
        bent = float(((np.array(after) - now) ** 2 / weight)[live].sum())
        proposed = max(1.0, moved / bent) if bent else 1.0
        if length > 1 and squares(np.array(after)) > max(seen[-JUDGED:]):
            length = max(1.0, min(length / 4, proposed))
            continue
        now, length = np.array(after), proposed
        seen.append(squares(now))
        history.append(moves)
        recent.append(moves)
    misses = (now - wanted) / scale
    return Rates(tuple(history), tuple(misses.tolist()), bool(np.abs(misses[live]).max(initial=0.0) < CLOSE))


def rated(docs: DataFrame, domains: Domains, weights: dict[str, float], id_col: str, text_col: str, anchor: str | None, most: float | None,
          *keep: Column) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, columns to keep, ``n_tokens``, ``posterior``, ``rate``, ``copies``."""
    names = [f"_keep{i}" for i in range(len(keep))]
    coin = F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_whole"), coin.alias("_coin"), *[c.alias(n) for c, n in zip(keep, names)])
    members = stage(with_posteriors(rows, domains, "doc_id", "_whole", "_coin", *names), "memberships") if domains.names else (
        rows.select("doc_id", "_coin", *names, F.size(words(F.coalesce("_whole", F.lit("")))).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("posterior")))
    wanted = [max(0.0, weights.get(k, 0.0)) for k in domains.names]
    fitted = Rates((), ())
    if sum(wanted) > 0:
        wanted = [w / sum(wanted) for w in wanted]
        row = members.agg(*[F.sum(F.col("n_tokens") * F.element_at("posterior", k + 1)) for k in range(len(wanted))]).first()
        mass = [float(v or 0) for v in row]
        place = domains.names.index(anchor) if anchor in domains.names else None
        total = sum(mass) if place is None or not wanted[place] else mass[place] / wanted[place]
        fitted = fit_rates(members, [w * total for w in wanted], most)
        if not fitted.reached:
            state = f"missed, as little as can be, after {fitted.steps} steps" if fitted.settled else f"not met after {STEPS} steps"
            warnings.warn(f"mixing targets are {state}; relative misses {dict(zip(domains.names, fitted.misses))}", stacklevel=2)
    rate = F.round(rate_column(fitted, most), 6)
    return members.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.col("_coin")).cast("long"))


def mix(docs: DataFrame, domains: Domains, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", anchor: str | None = None,
        most: float | None = None) -> DataFrame:
    """One row per document: the id, ``n_tokens``, ``domain`` (the likeliest), ``posterior`` of it, ``rate``, ``copies``.

    ``weights`` are target shares of the domains, made to sum to 1 over those that were learned; others and weights of
    unknown domains count as 0. The target total is all tokens, or what leaves the ``anchor`` domain's total as it is.
    ``most`` bounds every rate. Targets that no rates reach are missed as little as can be, with a warning that says by how
    much. ``copies`` rounds the rate up or down by the hash of the id and text, so that it is right on average. An
    empty text has 0 tokens and a rate like any other; without labelled rows every rate is 1 and ``domain`` is NULL. Every row is
    judged by itself; other columns are not read. An empty table gives an empty result.
    """
    best = F.array_max("posterior")
    names = F.array(*[F.lit(k) for k in domains.names]).cast("array<string>")
    found = rated(docs, domains, weights, id_col, text_col, anchor, most).withColumn("best", best)
    return found.select(F.col("doc_id").alias(id_col), "n_tokens", F.when(F.col("best").isNotNull(), F.get(names, (F.array_position("posterior", F.col("best")) - 1).cast("int"))).alias("domain"),
                        F.round("best", 6).alias("posterior"), "rate", "copies")


def mixed_rows(docs: DataFrame, domains: Domains, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", anchor: str | None = None,
               most: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its own ``copies`` in ``mix``, whatever other rows share its id."""
    found = rated(docs, domains, weights, id_col, text_col, anchor, most, F.struct("*")).filter("copies > 0")
    return found.select("_keep0", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_keep0.*")


def take_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mixed`` says; ids in ``mixed`` are taken as unique."""
    count = mixed.groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    joined = docs.join(count, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return joined.select(*[docs[c] for c in docs.columns])

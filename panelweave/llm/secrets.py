"""Secrets in whole texts by linking the parts of a credential.

A credential has parts: an access identifier, a secret, an endpoint it opens. Base spans follow fixed patterns and count by
themselves. Weak candidates (identifiers of other forms, short or unnamed secrets) look like a lot of harmless text, so
one is reported only with complementary parts in its scope: a strong part of the other kind, or a weak part of the other
kind and an endpoint. The scope of a candidate is its paragraph, up to ``REACH`` code points to either side.

Patterns are matched in the task that reads a text. The parts, never the texts, meet in an interval join: a paragraph is cut into
bins of ``REACH`` code points, the parts of a bin collapse by role and strength to the first start and the last end, and
a candidate looks at its own bins and their neighbours. That is exact and emits a bounded number of rows per candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import give_back, slices, stage

#: The kinds in the order in which they are listed, with their patterns; what a match needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex"]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Weak candidates: other identifiers, other assignments, tokens of mixed letters and digits; and endpoints.
WEAK_ACCESS = [
    re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}"),
    re.compile(r"""(?<![A-Za-z])(?:client_?id|access_?key_?id|key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A),
]
WEAK_ASSIGN = [
    re.compile(r"""(?<![A-Za-z])(?:pwd|pass|passphrase|credential|auth|private_?key|secret_?key|signature)["']?\x20*(?:[:=]|=>|is\x20)\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A),
    re.compile(r"(?<![A-Za-z])Bearer\x20+[A-Za-z0-9+/_.=-]{12,}", re.I | re.A),
]
TOKEN = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
MIXED = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]
ENDPOINT = [
    re.compile(r"""(?<![A-Za-z])(?:https?|ftp|sftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\s"'<>]+""", re.I | re.A),
    re.compile(r"""(?<![A-Za-z])(?:host|server|endpoint|bucket|database|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""", re.I | re.A),
]
#: What a text must hold, in small letters, for the assignments and endpoints to be looked for.
HINTS = ("passw", "secret", "token", "api")
WEAK_HINTS = ("client", "key", "account", "user", "login", "pwd", "pass", "credential", "auth", "signature", "bearer")
ENDPOINT_HINTS = ("://", "host", "server", "endpoint", "bucket", "database", "url")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

#: Code points on either side of a candidate that belong to its scope.
REACH = 160
#: Roles of parts.
IDENTIFIER, SECRET, END = "identifier", "secret", "endpoint"

Part = tuple[str, str, bool, int, int]


def base_parts(text: str, low: str) -> tuple[list[Part], list[Part]]:
    """Base spans, and matches that fail a length but may be weak candidates: (kind, role, strong, start, end)."""
    found, failed = [], []
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            strong = len(m[2]) >= LEAST_VALUE
            (found if strong else failed).append(("assign", SECRET, strong, m.start(), m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            strong = len(m[0]) >= LEAST_ACCESS
            (found if strong else failed).append(("access", IDENTIFIER, strong, m.start(), m.end()))
    for m in HEX.finditer(text):
        strong = len(m[0]) >= LEAST_HEX
        if strong or MIXED[0].search(m[0]) and MIXED[2].search(m[0]):
            (found if strong else failed).append(("hex", SECRET, strong, m.start(), m.end()))
    return found, failed


def weak_parts(text: str, low: str, base: list[Part], failed: list[Part]) -> list[Part]:
    """Weak candidates that overlap no base span; of candidates that overlap each other the first, longest stays."""
    wide = list(failed)
    if any(h in low for h in WEAK_HINTS):
        wide += [("access", IDENTIFIER, False, m.start(), m.end()) for m in WEAK_ACCESS[1].finditer(text)]
        wide += [("assign", SECRET, False, m.start(), m.end()) for p in WEAK_ASSIGN for m in p.finditer(text)]
    wide += [("access", IDENTIFIER, False, m.start(), m.end()) for m in WEAK_ACCESS[0].finditer(text)]
    wide += [("assign", SECRET, False, m.start(), m.end()) for m in TOKEN.finditer(text) if all(p.search(m[0]) for p in MIXED)]
    if not wide:
        return []
    taken = sorted((start, end) for _, _, _, start, end in base)
    out, at, reached, k = [], 0, 0, 0
    for part in sorted(set(wide), key=lambda p: (p[3], -p[4], KINDS.index(p[0]))):
        while k < len(taken) and taken[k][0] < part[4]:  # base spans that begin before the candidate's end
            reached, k = max(reached, taken[k][1]), k + 1
        if reached <= part[3] and at <= part[3]:
            out.append(part)
            at = part[4]
    return out


def endpoints(text: str, low: str) -> list[Part]:
    if not any(h in low for h in ENDPOINT_HINTS):
        return []
    return [("endpoint", END, True, m.start(), m.end()) for p in ENDPOINT for m in p.finditer(text)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def with_paragraphs(text: str, parts: list[Part]) -> list[dict]:
    """Parts with the number of the paragraph in which they begin."""
    breaks, out, n = [m.end() for m in PARAGRAPH.finditer(text)], [], 0
    for kind, role, strong, start, end in sorted(parts, key=lambda p: p[3]):
        while n < len(breaks) and breaks[n] <= start:
            n += 1
        out.append({"kind": kind, "role": role, "strong": strong, "start": start, "end": end, "paragraph": n})
    return out


def scan(text: str) -> dict:
    """Base counts and spans of a text, and its parts where a weak candidate could be linked."""
    low = text.lower()
    base, failed = base_parts(text, low)
    spans = [(kind, start, end) for kind, _, _, start, end in base]
    out = {f"n_{k}": sum(s[0] == k for s in spans) for k in KINDS}
    weak = weak_parts(text, low, base, failed)
    # Nothing is linked without an identifier and a secret.
    linkable = weak and len({p[1] for p in base + weak}) == 2
    return out | {"base": written(spans), "parts": with_paragraphs(text, base + weak + endpoints(text, low)) if linkable else []}


_PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("role", T.StringType()), T.StructField("strong", T.BooleanType()),
                      T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("paragraph", T.LongType())])
_SCANNED = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base", T.StringType()), T.StructField("parts", T.ArrayType(_PART))])


@F.arrow_udf(_SCANNED)
def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    give_back()
    kind = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("parts", pa.list_(pa.struct([
        ("kind", pa.string()), ("role", pa.string()), ("strong", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("paragraph", pa.int64())])))])
    for batch in batches:
        yield pa.concat_arrays([pa.array([scan(t) for t in part.to_pylist()], kind) for part in slices(batch)] or [pa.array([], kind)])


def linked(parts: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """The weak candidates among ``parts`` that complementary parts in their scope confirm.

    ``parts`` has ``keys`` (a text), ``paragraph``, ``kind``, ``role``, ``strong``, ``start``, ``end``.
    """
    scope = [*keys, "paragraph"]
    low, high = F.floor(F.col("start") / reach).cast("long"), F.floor((F.col("end") - 1) / reach).cast("long")
    # Within a bin the first start and the last end stand for all parts of a role: they are less than a reach apart.
    evidence = (parts.withColumn("bin", F.explode(F.sequence(low, high))).groupBy(*scope, "bin", F.col("role").alias("other"), F.col("strong").alias("sure"))
                .agg(F.min("start").alias("first"), F.max("end").alias("last")))
    weak = parts.filter(~F.col("strong")).withColumn("bin", F.explode(F.sequence(low - 1, high + 1)))
    near = (F.col("first") - F.col("end") <= reach) & (F.col("start") - F.col("last") <= reach) & (F.col("other") != F.col("role"))
    met = weak.join(evidence, [*scope, "bin"]).filter(near)
    part = F.col("other") != END
    return (met.groupBy(*scope, "kind", "role", "start", "end").agg(F.bool_or(part & F.col("sure")).alias("_sure"), F.bool_or(part).alias("_part"), F.bool_or(~part).alias("_end"))
            .filter(F.col("_sure") | F.col("_part") & F.col("_end")).drop("_sure", "_part", "_end"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: the id, counts of base spans by kind, ``base_sha256`` of the base spans, ``spans`` of all, ``n_linked``.

    Spans are written ``kind:start:end`` by start, then kind as listed, with commas between; places are code points, the
    end exclusive. ``n_linked`` counts the weak candidates that linking added; they overlap no base span and not each
    other. NULL and empty texts have none. Rows that repeat an id and text get the same answer each; other columns are not
    read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("n"), scanned(text).alias("s"))
    found = stage(made.select("id", "hash", "n", "s.*"), "secret-parts")
    keys = ["id", "hash", "n"]  # the content names a text, so equal rows share their links
    parts = found.filter(F.size("parts") > 0).select(*keys, F.explode("parts").alias("p")).select(*keys, "p.*").distinct()
    parts = parts.withColumn("id", F.struct("id"))  # a NULL id joins like any other
    span = F.struct("start", "end", "kind")
    added = linked(parts, keys, reach).groupBy(*keys).agg(F.collect_list(span).alias("added"))  # bounded by the text
    plain = found.filter(F.size("parts") == 0).withColumn("added", F.lit(None).cast("array<struct<start:bigint,end:bigint,kind:string>>"))
    rest = found.filter(F.size("parts") > 0)
    rest = rest.withColumn("_id", F.struct("id")).join(added.select(F.col("id").alias("_id"), "hash", "n", "added"), ["_id", "hash", "n"], "left").select(*plain.columns)
    both = plain.unionByName(rest)
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.split_part(s, F.lit(":"), F.lit(3)).cast("long").alias("end"), F.split_part(s, F.lit(":"), F.lit(1)).alias("kind")))
    order = F.transform(F.concat(base, F.col("added")), lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("label")))
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(order), lambda s: s["label"]), ","))
    return both.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), every.alias("spans"),
                       F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).cast("long").alias("n_linked"))

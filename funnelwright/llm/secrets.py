"""Secret scans with multipart credential linking, in SQL functions only.

Strong matches (`BASE`) are reported as they are. Weak parts (`WEAK`: account identifiers, key-like strings, endpoints)
are everywhere in clean text, so one is reported only when it starts within `SCOPE` code points of its complement: a key needs an
identifier, an identifier a secret, an endpoint both. The search is an interval join: parts are exploded, the partners
copied to the neighbouring cells of `SCOPE` code points, and weak parts kept by a semi-join on (text, cell) and distance.
A cell is a stretch of one text, so the parts in it are bounded by its length, whatever the corpus. Texts are known by
two hashes, and equal parts of equal rows are merged before the join: copies cost nothing.

Positions are code points, ends exclusive. They are running totals of the lengths of matches and of what `split` leaves
between them.

Defined cases: null text is empty and has no spans; repeated rows get the same spans each; null ids are ordinary; an
empty table gives an empty result. Added columns take a leading underscore where the input already has their name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, free_name, stored

# Fixed patterns of the strong kinds. Runs shorter than the stated length are dropped after matching: for `access` and
# `hex` a lower bound in the pattern is the same, as a match always takes the whole run; `assign` is checked by group 2.
KEYWORD = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
BASE = {
    "assign": rf"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_CHARS = 6
# Weak parts. A key must also mix capitals, small letters and digits.
WEAK = {
    "identifier": r"(?:[Cc]lient_?[Ii]d|[Aa]ccess_?[Kk]ey_?[Ii]d|[Uu]ser_?[Nn]ame|[Aa]ccount_?[Ii]d)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}",
    "key": r"[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}",
}
SCOPE = 256
KINDS = [*BASE, *WEAK]
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_CHUNK = 256


def running_totals(numbers: Column) -> Column:
    """Sum of the elements up to and including each one. Chunked, so that long arrays stay far from quadratic."""

    def totals(part: Column, start: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all")),
            lambda a: a["all"],
        )

    def summed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), totals(sums, F.lit(0)))
        return bound(before, lambda b: F.flatten(F.transform(chunks, lambda c, i: totals(c, F.get(b, i)))))

    numbers_of = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _CHUNK).cast("int"))
    return bound(F.transform(numbers_of, lambda c: F.slice(numbers, c * _CHUNK + 1, _CHUNK)), summed)


def _starts(text: Column, kind: str, found: Column) -> Column:
    """Where each match starts, from the lengths of the matches and of what lies between."""

    def starts(between: Column) -> Column:
        gaps = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)))
        return bound(gaps, running_totals)

    return bound(F.split(text, {**BASE, **WEAK}[kind], -1), starts)


def _span_of(kind: str, starts: Column, groups: Column | None) -> Callable[[Column, Column], Column]:
    """Match i of a kind as (start, rank, end, kind), and whether it is long and mixed enough."""

    def span(m: Column, i: Column) -> Column:
        start = F.get(starts, i)
        right = F.lit(True)
        if groups is not None:
            right = F.length(F.get(groups, i)) >= ASSIGN_CHARS
        if kind == "key":
            right = m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
        rank, end = F.lit(KINDS.index(kind)), start + F.length(m)
        return F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), right.alias("right"))

    return span


def find_spans(df: DataFrame, text_column: str = "text", kinds: list[str] = KINDS) -> DataFrame:
    """df plus one column per kind: an array of (start, rank, end, kind), in order."""
    text = free_name(df, "text_")
    out = df.withColumn(text, F.coalesce(F.col(text_column).cast("string"), F.lit("")))

    def spans_of(kind: str) -> Column:
        """Arrays are bound once each: whatever is pushed down, no element builds them anew."""
        groups = F.regexp_extract_all(F.col(text), F.lit(BASE["assign"]), F.lit(2)) if kind == "assign" else F.array().cast("array<string>")
        kept = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))

        def located(found: Column) -> Column:
            def checked(starts: Column, values: Column) -> Column:
                spans = F.transform(found, _span_of(kind, starts, values if kind == "assign" else None))
                return F.transform(F.filter(spans, lambda x: x["right"]), kept).cast(_SPANS)

            some = bound(_starts(F.col(text), kind, found), lambda at: bound(groups, lambda values: checked(at, values)))
            return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(some)

        return bound(F.regexp_extract_all(F.col(text), F.lit({**BASE, **WEAK}[kind]), F.lit(0)), located)

    out = out.withColumns({f"{text}_{kind}": spans_of(kind) for kind in kinds})
    names = {kind: free_name(df, kind) for kind in kinds}
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{text}_{kind}").alias(names[kind]) for kind in kinds])


def link(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Weak parts (keys, start, rank, end, kind) that have their complement within SCOPE."""
    cell = F.floor(F.col("start") / SCOPE)
    weak = parts.withColumn("cell", cell)

    def beside(rows: DataFrame, kinds: list[str]) -> DataFrame:
        partners = (
            parts.where(F.col("kind").isin(kinds))
            .select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("start").alias("p_start"), F.col("end").alias("p_end"))
            .select("*", F.explode(F.sequence(F.floor((F.col("p_start") - SCOPE) / SCOPE), F.floor((F.col("p_end") + SCOPE) / SCOPE))).alias("p_cell"))
        )
        same = F.col("cell") == F.col("p_cell")
        for k in keys:
            same = same & (F.col(k) == F.col(f"p_{k}"))
        near = (F.col("start") <= F.col("p_end") + SCOPE) & (F.col("start") >= F.col("p_start") - SCOPE)
        return rows.join(partners, same & near, "left_semi")

    names, secrets = ["access", "identifier"], ["assign", "hex", "key"]
    linked = [
        beside(weak.where("kind = 'key'"), names),
        beside(weak.where("kind = 'identifier'"), secrets),
        beside(beside(weak.where("kind = 'endpoint'"), secrets), names),
    ]
    return linked[0].union(linked[1]).union(linked[2]).drop("cell")


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """df plus `base_spans` and `spans` (strong and linked): arrays of (start, rank, end, kind) by start, then kind.

    The text is read twice: once for the weak parts of the few texts that hold complements, once for the result.
    """
    k1, k2 = free_name(df, "k1"), free_name(df, "k2")
    keys = {k1: F.xxhash64(F.col(id_column), F.lit(1), F.col(text_column)), k2: F.xxhash64(F.col(text_column), F.lit(2), F.col(id_column))}
    narrow = df.select(F.col(text_column).cast("string").alias("text"), keys[k1].alias("k1"), keys[k2].alias("k2"))
    # Whatever can be linked has a weak part and a secret or a key: one cheap test keeps most texts out.
    maybe = narrow.where(F.col("text").rlike("|".join(f"(?:{p})" for p in WEAK.values())))
    found = find_spans(maybe).withColumn("parts", F.concat(*[F.col(k) for k in KINDS]))
    several = F.size(F.array_distinct(F.transform("parts", lambda x: x["kind"]))) > 1
    parts = found.where(several).select("k1", "k2", F.inline("parts")).distinct()
    linked = stored(
        link(stored(parts, "secret-parts"), ["k1", "k2"])
        .groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2))
        .agg(F.collect_list(F.struct("start", "rank", "end", "kind")).cast(_SPANS).alias("linked")),
        "linked-secrets",
    )
    extra = free_name(df, "linked")
    base = find_spans(df.withColumns(keys), text_column, list(BASE))
    base = base.withColumn(free_name(df, "base_spans"), F.sort_array(F.concat(*[F.col(c) for c in base.columns[-3:]])))
    out = base.join(linked.withColumnRenamed("linked", extra), [k1, k2], "left")
    strong = F.col(free_name(df, "base_spans"))
    every = F.when(F.col(extra).isNull(), strong).otherwise(F.sort_array(F.concat(strong, F.col(extra))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], strong, every.alias(free_name(df, "spans")))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by `mark`."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))))
            .alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)

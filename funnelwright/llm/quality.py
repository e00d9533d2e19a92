"""Quality rules with host verdicts, in SQL functions only.

`measure` counts words, symbols, repeated lines and repeated three-word windows of each whole text inside its row: no
shuffle, and no row grows beyond a few arrays as long as its words. Windows are compared by 64-bit hash within one text.

`judge_hosts` then works on the measured rows (store them without their text first): failures of each rule are summed
by host, map-side first, so a host with a third of all rows costs a task no more than any other. Each rule gets a beta
prior fitted to all hosts (weighted moments); a host's rate is its posterior mean, and a host fails a rule if that mean
less `Z` posterior deviations is still above `HOST_RATE`: a small host needs the support of the prior, a host with a few
bad pages is left alone. Only eight sums come to the driver. The verdicts are joined back by host.

Defined cases: null text has no words, so it is too short; a null host is a host of its own; repeated rows count each
time; with one host, or equal rates, the prior is as strong as `STRONGEST` rows; an empty table gives an empty result.
Added columns take a leading underscore where the input already has their name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bound, free_name

MIN_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS_PERCENT = 100
LINES_PERCENT = 50
HOST_RATE = 0.5
Z = 2.0
STRONGEST = 1e6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "lines")
_TRIM = "\x20\t\n\x0b\x0c\r"


def _covered(sorted_windows: Column) -> Column:
    """Words in three-word windows whose hash comes twice or more; the windows are sorted by hash."""
    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get(sorted_windows, i - 1)["h"], F.get(sorted_windows, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(sorted_windows, repeated), lambda x: x["i"]))
    # Each start covers three words, less those that the start before covers already.
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _measures(text: Column) -> Column:
    """All measures of a text as one struct. Each array is bound once, so no filter on a measure builds it for each element."""
    trimmed = F.btrim(text, F.lit(_TRIM))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_TRIM)) != "")

    def with_words(w: Column) -> Column:
        windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return bound(F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda h: bound(lines, lambda found: of(w, h, found)))

    def of(w: Column, h: Column, found: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(found),
            "n_dup_lines": F.size(found) - F.size(F.array_distinct(found)),
            "n_repeat_words": F.when(F.size(F.array_distinct(h)) < F.size(h), bound(in_order, _covered)).otherwise(0),
        }
        return F.struct(*[v.cast("long").alias(n) for n, v in values.items()])

    return bound(words, with_words)


def measure(df: DataFrame, text_column: str = "text") -> DataFrame:
    """df plus n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of each text.

    `measured_names` says which columns they are where the input has some of these names already.
    """
    measures = free_name(df, "measures")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    out = df.withColumn(measures, _measures(text))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{measures}.{n}").alias(name) for n, name in measured_names(df).items()])


def measured_names(df: DataFrame) -> dict[str, str]:
    """The columns that `measure(df)` adds: measure -> name."""
    return {n: free_name(df, n) for n in MEASURES}


def failures(names: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Each rule as a Column over the measures; the first two are the base rules of a document."""
    m = {k: F.col(f"`{(names or {}).get(k, k)}`") for k in MEASURES}
    n = m["n_words"]
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > REPEATED_PERCENT * n,
        "symbols": 100 * m["n_symbols"] > SYMBOLS_PERCENT * n,
        "lines": 100 * m["n_dup_lines"] > LINES_PERCENT * m["n_lines"],
    }


def host_rates(measured: DataFrame, host_column: str = "source", names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per host: host, n and for each rule its failures, shrunken rate and lower bound of that rate."""
    hosts = measured.groupBy(F.col(f"`{host_column}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v.cast("long")).alias(k) for k, v in failures(names).items()]
    )
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n")]
    for rule in RULES:  # sum of k and of k * k / n give mean and variance of the rates
        sums += [F.sum(rule).alias(rule), F.sum(F.col(rule).cast("double") * F.col(rule) / n).alias(f"{rule}_sq")]
    total = hosts.agg(*sums).first()
    for rule in RULES:
        alpha, strength = beta_prior(total["hosts"], total["n"] or 0.0, total[rule] or 0, total[f"{rule}_sq"] or 0.0)
        rate = (F.col(rule) + alpha) / (n + strength)
        hosts = hosts.withColumn(f"{rule}_rate", rate)
        hosts = hosts.withColumn(
            f"{rule}_low", F.col(f"{rule}_rate") - Z * F.sqrt(F.col(f"{rule}_rate") * (1 - F.col(f"{rule}_rate")) / (n + strength + 1))
        )
    return hosts


def beta_prior(hosts: int, rows: float, failed: float, squares: float) -> tuple[float, float]:
    """(alpha, alpha + beta) by moments: the variance of the rates beyond what sampling explains."""
    if not rows:
        return 0.0, 1.0
    mean = failed / rows
    sampling = mean * (1 - mean)
    excess = squares / rows - mean * mean - sampling * hosts / rows
    strength = min(STRONGEST, max(sampling / excess - 1, 0.1)) if excess > 0 else STRONGEST
    return mean * strength, strength


def judge_hosts(measured: DataFrame, host_column: str = "source", names: Mapping[str, str] | None = None) -> DataFrame:
    """Measured rows plus base_failed, host_failed and kept; names: the columns of the measures, if not their own names."""
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | (F.col(f"{rule}_low") > HOST_RATE)
    host, verdict = free_name(measured, "host"), free_name(measured, "host_failed")
    hosts = host_rates(measured, host_column, names).select(F.col("host").alias(host), bad.alias(verdict))
    rule = failures(names)
    base = free_name(measured, "base_failed")
    out = measured.join(hosts, measured[host_column].eqNullSafe(hosts[host]), "left").drop(host)
    out = out.withColumn(base, rule["short"] | rule["repeats"])
    return out.withColumn(free_name(measured, "kept"), ~(F.col(base) | F.coalesce(F.col(verdict), F.lit(False))))

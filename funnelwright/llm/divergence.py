"""Source divergence audit by one-hot level products.

How far is each source's word use from that of the other sources, and of its whole language? A group is a (lang, source).

1. Each task counts terms by group in a bounded dictionary that is sent on whenever it is full; the counts are dealt by
   (lang, term), where occurrences and documents of a term are summed. Each language keeps the terms in enough documents.
2. The kept terms of a language are dealt into blocks of about `TERMS` terms of similar frequency, the groups into blocks of
   `GROUPS`. A task takes one block of terms and one pair of blocks of groups: for each group and each count level that
   occurs there it sets an indicator column over the terms, and multiplies the columns by their transpose. The entries are
   whole numbers below 2^24, exact in single precision: how many terms have level a in group g and level b in group h.
   Summed over blocks of terms, they are the joint table of every pair of groups.
3. A smoothed share depends on group and level alone, so each cell of a joint table has one price, |p - q|, and a pair's
   divergence is the sum of counts times prices. The cell (0, 0) is what the other cells leave of the kept terms.

All arithmetic is in whole numbers (decimals where a long could overflow). A hot group or term costs a task no more than any
other: counts are summed in the tasks first, and a block holds at most 2 x GROUPS groups. The result itself has a row for
every pair of sources of a language; nothing else grows with pairs.

Defined cases: null text, lang and source are empty strings; groups without terms are in the result, with shares of level 0;
a language that keeps no term has divergences of 0; a group alone in its language has no pair; repeated rows count each
time; ties are broken by the item's bytes; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, releasing, slices, stored, utf8

MIN_DOCS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP = 50
TERMS = 128
GROUPS = 64
# Entries of a task's dictionaries before they are sent on.
HELD = 200_000

# Letters and bytes from 128 on are kept, A-Z as a-z; all else separates.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _sent(counts: dict[tuple[str, str], Counter], docs: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    for group, of_group in counts.items():
        terms = list(of_group)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group[0]] * len(terms), pa.string()),
                pa.array([group[1]] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(of_group.values(), pa.int64()),
                pa.array(map(docs[group].__getitem__, terms), pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


@releasing
def _count(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    full = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for low, high in slices(batch.column("text")):
            data, offsets = utf8(batch.column("text").slice(low, high - low))
            for i in range(low, high):
                terms = data[offsets[i - low] : offsets[i - low + 1]].tobytes().translate(_FOLD).split()
                if not terms:
                    continue
                of_group = counts.setdefault((langs[i], sources[i]), Counter())
                before = len(of_group)
                of_group.update(terms)
                docs.setdefault((langs[i], sources[i]), Counter()).update(set(terms))
                full += len(of_group) - before
                if full >= held:
                    yield from _sent(counts, docs)
                    counts, docs, full = {}, {}, 0
    yield from _sent(counts, docs)


def term_counts(df: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, lang_n) of the kept terms; df: (lang, source, text) without nulls in lang and source."""
    counted = df.select("lang", "source", "text").mapInArrow(partial(_count, held=held), "lang string, source string, term string, n long, docs long")
    # Dealt by language and term once: the sums by group and those by language need no other exchange.
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = summed.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return kept.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n")


def _one_hot(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of one group that occur, and an indicator column over the terms for each."""
    found, code = np.unique(levels, return_inverse=True)
    return found, (code[:, None] == np.arange(len(found))).astype(np.float32)


def _joint(table: pa.Table, groups: int) -> pa.Table:
    """Cells of the joint tables that one block of terms adds for one pair of blocks of groups."""
    lang, left, right, size = (table.column(c)[0].as_py() for c in ("lang", "left", "right", "size"))
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    g, n = table.column("g").to_numpy(), table.column("n").to_numpy()
    columns = {}
    for number in {left, right}:
        for group in range(number * groups, min(size, (number + 1) * groups)):
            levels = np.zeros(int(term.max()) + 1, np.int64)
            own = g == group
            levels[term[own]] = n[own]
            columns[group] = _one_hot(levels)
    first = [x for x in columns if x // groups == left]
    ids = np.concatenate([np.full(len(columns[x][0]), x) for x in first])
    levels = np.concatenate([columns[x][0] for x in first])
    indicators = np.hstack([columns[x][1] for x in first])
    parts = []
    for h in (x for x in columns if x // groups == right):
        before = ids < h
        product = indicators[:, before].T @ columns[h][1]
        a, b = np.nonzero(product)
        level_a, level_b = levels[before][a], columns[h][0][b]
        some = (level_a > 0) | (level_b > 0)
        cells = (ids[before][a], np.full(len(a), h), level_a, level_b, product[a, b].astype(np.int64))
        parts.append([c[some] for c in cells])
    g, h, level_g, level_h, terms = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.Table.from_arrays(
        [pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(h, pa.int32()), pa.array(level_g), pa.array(level_h), pa.array(terms)],
        ["lang", "g", "h", "level_g", "level_h", "terms"],
    )


def joint_tables(cells: DataFrame, terms: int = TERMS, groups: int = GROUPS) -> DataFrame:
    """(lang, g, h, level_g, level_h, terms) for g < h: terms of that language with these counts in both groups.

    cells: (lang, term, g, n, lang_n, size), stored; g numbers the groups of a language from 0, `size` counts them. The cell
    of level 0 in both is left out: it is what the others leave of the kept terms.
    """
    tier = F.floor(F.log2("lang_n")).cast("int")
    # Terms of similar frequency share levels, so their columns are few.
    tiers = cells.select("lang", tier.alias("tier"), "term").distinct().groupBy("lang", "tier").agg(F.ceil(F.count(F.lit(1)) / terms).alias("blocks"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    dealt = cells.withColumn("tier", tier).join(tiers, ["lang", "tier"]).withColumn("block", block)
    own = F.floor(F.col("g") / groups).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / groups).cast("int")))
    dealt = dealt.select("lang", "tier", "block", own.alias("own"), other.alias("other"), "term", "g", "n", "size")
    dealt = dealt.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("own", "other")

    def product(block: pa.Table) -> pa.Table:
        return _joint(block, groups)

    # Dealt by all five: a partitioning left over from the join with the tiers would satisfy the grouping, and would put all
    # blocks of a language's tier in one task.
    keys = ["lang", "tier", "block", "left", "right"]
    products = dealt.repartition(*keys).groupBy(*keys).applyInArrow(
        product, "lang string, g int, h int, level_g long, level_h long, terms long"
    )
    return products.groupBy("lang", "g", "h", "level_g", "level_h").agg(F.sum("terms").alias("terms"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR kept)), in whole numbers; null if there is nothing to divide by."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    bottom = F.nullif((total + PRIOR * kept).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", top, bottom) + 1


def audit(
    df: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair`, the divergence from each other source; `term`, the most overused terms."""
    named = {"lang": lang_column, "source": source_column, "text": text_column}
    docs = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in named.items()])
    counts = stored(term_counts(bounded_batches(docs), min_docs), "term-counts")
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang")
    langs = langs.agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = groups.withColumns({"g": F.row_number().over(by_source) - 1, "size": F.count(F.lit(1)).over(Window.partitionBy("lang"))})
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")]
    groups = stored(groups.join(langs, "lang", "left").select("lang", "source", "g", F.col("size").cast("int"), *filled), "audit-groups")

    cells = stored(counts.join(groups, ["lang", "source"]), "audit-cells")
    joint = joint_tables(cells.select("lang", "term", "g", "n", "lang_n", "size"))
    side = {k: groups.select("lang", F.col("g").alias(k), F.col("total").alias(f"total_{k}"), *(["kept"] if k == "g" else [])) for k in ("g", "h")}
    priced = joint.join(side["g"], ["lang", "g"]).join(side["h"], ["lang", "h"])
    kept = F.col("kept")
    price = F.abs(share(F.col("level_g"), F.col("total_g"), kept) - share(F.col("level_h"), F.col("total_h"), kept))
    priced = priced.groupBy("lang", "g", "h").agg(F.sum(F.col("terms") * price).alias("some"), F.sum("terms").alias("covered"))

    a = groups.select("lang", "source", "g", "total", "kept")
    b = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("total").alias("total_h"))
    pairs = a.join(b, "lang").where("g <> h").withColumns({"low": F.least("g", "h"), "high": F.greatest("g", "h")})
    priced = priced.select("lang", F.col("g").alias("low"), F.col("h").alias("high"), "some", "covered")
    pairs = pairs.join(priced, ["lang", "low", "high"], "left")
    zero = F.abs(share(F.lit(0), F.col("total"), kept) - share(F.lit(0), F.col("total_h"), kept))
    uncovered = (kept - F.coalesce("covered", F.lit(0))) * F.coalesce(zero, F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("some", F.lit(0)) + uncovered).alias("value"))

    over = share(F.col("n"), F.col("total"), kept) - share(F.col("lang_n"), F.col("lang_total"), kept)
    terms = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    terms = terms.select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(terms)

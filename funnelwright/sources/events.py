"""Sessions out of a flat event log (one record per hit).

A visit is a run of one visitor's events with no pause above 12 hours. Events
are first grouped into cells (visitor, day, slot of the day). A cell is never
wider than the pause, so a visit can only begin where a cell begins: visits
are found on the cells, whose number per visitor is bounded by the calendar,
never on the events. One visitor holding a third of all events is therefore
pre-aggregated map-side, and is spread over many cells wherever single events
are still needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bloom import bloom_filter, might_hold
from ..functions.rules import ACTION_CODES, RAW_FLAGS

VISIT_PAUSE = "INTERVAL '12' HOUR"
ROW_SLOT_SECONDS = 3600
HIT_SLOT_SECONDS = 60
PIECE_HITS = 500
ROW_KEY = ["fullVisitorId", "visitId", "date"]
CELL_KEY = ["fullVisitorId", "date", "slot"]

# What each event type stands for.
PAGE_PATH = {
    "view": "/home",
    "click": "/basket.html",
    "signup": "/signin.html",
    "purchase": "/ordercompleted.html",
}
ACTION_TYPE = {"view": "2", "click": "3", "signup": "5", "purchase": "6", "error": "0"}

# Traffic attributes by the visit's class number, as (first, last, value).
CHANNEL = [
    (0, 11, "Organic Search"), (12, 18, "Social"), (19, 24, "Direct"), (25, 31, "Referral"),
    (32, 33, "Paid Search"), (34, 34, "Affiliates"), (35, 35, "Display"), (36, 37, "Referral"),
    (38, 38, "(Other)"),
]
SOURCE = [
    (0, 6, "google"), (7, 10, "(direct)"), (11, 11, "bing"), (12, 17, "youtube.com"),
    (18, 18, "facebook.com"), (19, 28, "(direct)"), (29, 29, "google.com"), (30, 30, "qiita.com"),
    (31, 31, None), (32, 33, "google"), (34, 34, "Partners"), (35, 35, "dfa"),
    (36, 36, "mail.google.com"), (37, 37, "analytics.google.com"), (38, 39, "other"),
]
MEDIUM = [
    (0, 6, "organic"), (7, 10, "(none)"), (11, 11, "organic"), (12, 18, "referral"), (19, 28, "(none)"),
    (29, 31, "referral"), (32, 33, "cpc"), (34, 34, "affiliate"), (35, 35, "cpm"), (36, 37, "referral"),
    (38, 39, "(not set)"),
]
REFERRAL_PATH = [(25, 27, "/"), (28, 28, "/offer/2145"), (30, 30, "/r")]
DEVICE = [(0, 6, "desktop"), (7, 8, "mobile"), (9, 9, "tablet")]
COUNTRY = [
    (0, 11, "United States"), (12, 16, "India"), (17, 20, "United Kingdom"), (21, 23, "Canada"),
    (24, 25, "Vietnam"), (26, 27, "Germany"), (28, 28, "(not set)"),
]
NETWORK = [
    (0, 3, "(not set)"), (4, 4, "comcast.net"), (5, 5, "verizon.net"), (6, 6, "rr.com"), (7, 7, "google.com"),
]


def _by_range(column: str, ranges: list[tuple[int, int, str | None]], name: str) -> Column:
    whens = " ".join(
        f"WHEN {column} BETWEEN {first} AND {last} THEN '{value}'" for first, last, value in ranges if value is not None
    )
    return F.expr(f"CASE {whens} END").alias(name)


def _by_type(values: dict[str, str], name: str) -> Column:
    whens = " ".join(f"WHEN '{kind}' THEN '{value}'" for kind, value in values.items())
    return F.expr(f"CASE event_type {whens} END").alias(name)


def _stamped(events: DataFrame, slot_seconds: int) -> DataFrame:
    """Events with their cell and their hit fields; only the needed columns.

    An event without a visitor or a time belongs to no visit, on any path.
    """
    return events.where("user_id IS NOT NULL AND ts IS NOT NULL").select(
        F.expr("CAST(user_id AS STRING)").alias("fullVisitorId"),
        F.expr("CAST(ts AS DATE)").alias("date"),
        F.expr(f"(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) DIV {slot_seconds}").alias("slot"),
        "ts",
        "event_id",
        F.expr("IF(event_type = 'error', 'EVENT', 'PAGE')").alias("type"),
        _by_type(PAGE_PATH, "page_path"),
        F.when(F.expr("event_id % 11 <> 0"), _by_type(ACTION_TYPE, "action_type")).alias("action_type"),
        F.expr("event_type = 'purchase'").alias("is_purchase"),
        F.expr(
            "CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 "
            "THEN CAST(FLOOR(value * 100 + 0.5D) AS BIGINT) * 10000 END"
        ).alias("tx_revenue"),
    )


def _numbered_cells(cells: DataFrame) -> DataFrame:
    """Cells with the ordinal of their visit among the visitor's visits."""
    ordered = Window.partitionBy("fullVisitorId").orderBy("date", "slot")
    previous = F.lag("last_ts").over(ordered)
    return (
        cells.withColumn("previous", previous)
        .withColumn("starts", F.expr(f"IF(previous + {VISIT_PAUSE} >= first_ts, 0, 1)"))
        .withColumn("visit_ord", F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("previous", "starts")
    )


def _with_attributes(rows: DataFrame) -> DataFrame:
    """Traffic, device and place of a row, from the visitor and the visit's ordinal."""
    numbered = rows.withColumn("user", F.col("fullVisitorId").cast("bigint")).withColumns(
        {
            "k": F.expr("(user * 7 + visit_ord * 11) % 40"),
            "of_10": F.expr("user % 10"),
            "of_30": F.expr("user % 30"),
            "of_9": F.expr("user % 9"),
        }
    )
    return numbered.select(
        *rows.columns,
        F.expr("CAST(visit_ord + IF(of_10 = 0, 3, 0) AS BIGINT)").alias("visitNumber"),
        _by_range("k", CHANNEL, "channel"),
        _by_range("k", SOURCE, "source"),
        _by_range("k", MEDIUM, "medium"),
        F.expr(
            "CASE WHEN k BETWEEN 19 AND 24 THEN TRUE "
            "WHEN visit_ord % 2 = 0 AND (k BETWEEN 7 AND 10 OR k BETWEEN 25 AND 28) THEN TRUE END"
        ).alias("is_true_direct"),
        _by_range("k", REFERRAL_PATH, "referral_path"),
        _by_range("of_10", DEVICE, "device"),
        _by_range("of_30", COUNTRY, "country"),
        _by_range("of_9", NETWORK, "net_domain"),
        F.expr("IF(visit_ord = 1 AND of_10 <> 0, CAST(1 AS BIGINT), NULL)").alias("new_visits"),
    )


def rows_from_events(events: DataFrame, slot_seconds: int = ROW_SLOT_SECONDS) -> DataFrame:
    """Row facts (see `operators.sessions.row_facts`), one per visit and day.

    Two exchanges: the pre-aggregated cells by cell key, then the cells by
    visitor; the row, session and visitor levels above reuse the second one.
    """
    cells = _stamped(events, slot_seconds).groupBy(*CELL_KEY).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("event_id").alias("first_id"),
        F.count("*").alias("n_hits"),
        F.expr("count_if(type = 'PAGE')").alias("n_pages"),
        F.expr("max(CAST(is_purchase AS BIGINT))").alias("has_tx"),
        F.min("tx_revenue").alias("revenue"),
        F.sum("tx_revenue").alias("hit_revenue"),
        *[
            F.expr(f"max(IF(action_type = '{code}', 1, 0))").alias(name)
            for name, code in zip(RAW_FLAGS, ACTION_CODES)
        ],
        F.expr("min_by(page_path, CASE WHEN type = 'PAGE' THEN struct(ts, event_id) END)").alias("landing_page"),
        F.expr("min(CASE WHEN type = 'PAGE' THEN ts END)").alias("landing_ts"),
    )
    rows = (
        _numbered_cells(cells)
        .groupBy("fullVisitorId", "visit_ord", "date")
        .agg(
            F.min("first_id").alias("first_id"),
            F.sum("n_hits").alias("n_hits"),
            F.sum("n_pages").alias("n_pages"),
            F.max("has_tx").alias("has_tx"),
            F.min("revenue").alias("revenue"),
            F.sum("hit_revenue").alias("hit_revenue"),
            *[F.max(name).alias(name) for name in RAW_FLAGS],
            F.min_by("landing_page", "landing_ts").alias("landing_page"),
        )
        .withColumn("visitId", F.min("first_id").over(Window.partitionBy("fullVisitorId", "visit_ord")))
    )
    return _with_attributes(rows).selectExpr(
        "fullVisitorId",
        "visitId",
        "CAST(date AS STRING) AS date",
        "visitNumber",
        "channel",
        "source",
        "medium",
        "is_true_direct",
        "referral_path",
        "device",
        "country",
        "net_domain",
        "n_hits AS total_hits",
        "nullif(n_pages, 0) AS pageviews",
        "nullif(has_tx, 0) AS transactions",
        "revenue",
        "new_visits",
        "n_hits",
        *RAW_FLAGS,
        "hit_revenue",
        "landing_page",
    )


def _visit_of_cells(stamped: DataFrame) -> DataFrame:
    """Per cell: its visit, and the visit's hits before the cell."""
    by_visit = Window.partitionBy("fullVisitorId", "visit_ord")
    before = by_visit.orderBy("date", "slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = stamped.groupBy(*CELL_KEY).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("event_id").alias("first_id"),
        F.count("*").alias("cell_hits"),
    )
    return (
        _numbered_cells(cells)
        .withColumn("visitId", F.min("first_id").over(by_visit))
        .withColumn("hits_before", F.coalesce(F.sum("cell_hits").over(before), F.lit(0)))
        .select(*CELL_KEY, "visitId", "hits_before")
    )


def hits_from_events(
    events: DataFrame, slot_seconds: int = HIT_SLOT_SECONDS, visits: DataFrame | None = None, filter_words: int = 64
) -> DataFrame:
    """Hit facts (see `operators.sessions.hit_facts`), one per event.

    The only join is events to their own cells, by the cell key; the numbering
    inside a cell reuses its partitioning, and the position of the cell in the
    visit comes from the cells.

    With `visits` (fullVisitorId, visitId), only their hits: a Bloom filter of
    the visitors leaves the other events in the scan's stage, and the visits
    are then joined exactly, before a hit is numbered.
    """
    stamped = _stamped(events, slot_seconds)
    if visits is not None:
        stamped = stamped.where(might_hold(bloom_filter(visits, "fullVisitorId", filter_words), F.col("fullVisitorId")))
    cells = _visit_of_cells(stamped)
    if visits is not None:
        cells = cells.join(visits.select(*ROW_KEY[:2]), ROW_KEY[:2], "left_semi")
    in_cell = Window.partitionBy(*CELL_KEY).orderBy("ts", "event_id")
    return (
        stamped.join(cells, CELL_KEY)
        .withColumn("hitNumber", (F.col("hits_before") + F.row_number().over(in_cell)).cast("bigint"))
        .select(
            *ROW_KEY[:2],
            F.col("date").cast("string").alias("date"),
            "hitNumber",
            "type",
            "page_path",
            "action_type",
            F.when(F.col("is_purchase"), _tx_id()).alias("tx_id"),
            "tx_revenue",
        )
    )


def transaction_sessions_from_events(events: DataFrame, slot_seconds: int = ROW_SLOT_SECONDS) -> DataFrame:
    """One line per visit with a purchase: its transaction id, hits with it, hits with revenue, and their sum.

    Purchases are summed in the cells that find the visits, so there is one scan and no join.
    """
    cells = _stamped(events, slot_seconds).groupBy(*CELL_KEY).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("event_id").alias("first_id"),
        F.count_if("is_purchase").alias("hit_rows"),
        F.count("tx_revenue").alias("rev_hits"),
        F.sum("tx_revenue").alias("revenue"),
    )
    visits = _numbered_cells(cells).groupBy("fullVisitorId", "visit_ord").agg(
        F.min("first_id").alias("visitId"), *[F.sum(c).alias(c) for c in ("hit_rows", "rev_hits", "revenue")]
    )
    return visits.where("hit_rows > 0").select(_tx_id().alias("tx_id"), *ROW_KEY[:2], "hit_rows", "rev_hits", "revenue")


def _tx_id() -> Column:
    """Repeated purchases of a visit re-issue one id."""
    return F.concat(F.lit("ORD"), F.col("visitId").cast("string"))


def nested_from_events(events: DataFrame, piece_hits: int = PIECE_HITS) -> DataFrame:
    """Nested session rows in the shape of `schemas.RAW_SESSION`.

    The hits of a row come in pieces of at most `piece_hits`, numbered by
    `piece`, so no array grows with the visit. `totals` are those of the whole
    row, repeated on each piece.
    """
    hit = F.struct(
        "hitNumber",
        "type",
        F.struct(F.col("page_path").alias("pagePath")).alias("page"),
        F.struct("action_type").alias("eCommerceAction"),
        F.struct(
            F.col("tx_id").alias("transactionId"), F.col("tx_revenue").alias("transactionRevenue")
        ).alias("transaction"),
    )
    pieces = (
        hits_from_events(events)
        .withColumn("piece", F.floor((F.col("hitNumber") - 1) / piece_hits).cast("int"))
        .groupBy(*ROW_KEY, "piece")
        .agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    )
    rows = rows_from_events(events).select(
        *ROW_KEY,
        "visitNumber",
        F.col("channel").alias("channelGrouping"),
        F.struct(
            "source",
            "medium",
            F.col("is_true_direct").alias("isTrueDirect"),
            F.col("referral_path").alias("referralPath"),
        ).alias("trafficSource"),
        F.struct(F.col("device").alias("deviceCategory")).alias("device"),
        F.struct("country", F.col("net_domain").alias("networkDomain")).alias("geoNetwork"),
        F.struct(
            F.col("total_hits").alias("hits"),
            "pageviews",
            "transactions",
            F.col("revenue").alias("transactionRevenue"),
            F.col("new_visits").alias("newVisits"),
        ).alias("totals"),
    )
    return rows.join(pieces, ROW_KEY)

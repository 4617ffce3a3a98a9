"""The figures behind a written report, as a long table and as one document.

Each source is read once and reduced to its dimensions; all figures then come from those small
tables, which are pinned because several steps read them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.dates import month_period
from tidemark.functions.scalars import percent_of, round_to, safe_ratio, sum_or_zero, whole_money
from tidemark.operators import kpis
from tidemark.operators.filters import FilterParams, apply_filters
from tidemark.operators.funnel import best_and_worst
from tidemark.session import pin_all


def _grouped(cube: DataFrame, section: str, metric: str, dim: str, value: Column) -> DataFrame:
    return (
        cube.filter(F.col(dim).isNotNull())
        .groupBy(F.col(dim).alias("name"))
        .agg(value.cast("double").alias("value"))
        .select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "name", "value",
                F.lit(None).cast("string").alias("text"))
    )


def _figures(one_row: DataFrame, section: str, column: str, **figures: Column) -> DataFrame:
    """Named figures of a one-row table as rows, in the `value` or the `text` column."""
    none = F.lit(None)

    def row(name, figure):
        return F.struct(
            F.lit(section).alias("section"), F.lit(name).alias("metric"), none.cast("string").alias("name"),
            (figure if column == "value" else none).cast("double").alias("value"),
            (figure if column == "text" else none).cast("string").alias("text"),
        )

    return one_row.select(F.inline(F.array(*[row(n, c) for n, c in figures.items()])))


def context_metrics(online: DataFrame, offline: DataFrame, media: DataFrame, crm: DataFrame, start=None, end=None) -> DataFrame:
    """Long table: section, metric, name (of the group, if any), value, text."""
    params = FilterParams(start, end)
    won = F.col("outcome") == C.CLOSED_WON
    web, shop, spend, funnel = pin_all(
        apply_filters(online, "date", params)
        .groupBy("channel", "category", month_period(F.col("date")).alias("month"))
        .agg(F.sum("revenue").alias("revenue"), F.min("date").alias("first"), F.max("date").alias("last")),
        apply_filters(offline, "week_start", params).groupBy("region").agg(F.sum("total_revenue").alias("revenue")),
        apply_filters(media, "week_start", params)
        .groupBy("channel")
        .agg(F.sum("spend").alias("spend"), F.sum("incremental_revenue").alias("incremental"), F.avg("roas").alias("roas")),
        apply_filters(crm, "lead_date", params)
        .groupBy("lead_source")
        .agg(
            F.count("*").alias("leads"), F.count("contact_id").alias("contacts"),
            sum_or_zero("reached_close").alias("reached"), F.count_if(won).alias("won"),
            F.sum(F.when(won, F.col("deal_value"))).alias("pipeline"),
            F.count(F.when(won, F.col("deal_value"))).alias("deals"),
        ),
    )
    revenue = kpis._one_row(
        web.agg(sum_or_zero("revenue").alias("web"), F.min("first").alias("first"), F.max("last").alias("last")),
        shop.agg(sum_or_zero("revenue").alias("shop")),
        kpis.mom_change(web, "month").drop("month"),
    )
    total = F.col("web") + F.col("shop")
    paid = spend.agg(sum_or_zero("spend").alias("spend"), sum_or_zero("incremental").alias("incremental"))
    deals = funnel.agg(*[sum_or_zero(c).alias(c) for c in ("leads", "won", "pipeline", "deals")])
    rated = funnel.filter(F.col("lead_source").isNotNull()).withColumn(
        "win_rate", percent_of(F.col("reached"), F.col("contacts"))
    )
    by = F.sum
    parts = [
        _figures(
            revenue, "period", "text",
            start=F.lit(str(start)) if start else F.col("first"), end=F.lit(str(end)) if end else F.col("last"),
        ),
        _figures(
            revenue, "revenue", "value",
            online_total=whole_money("web"), offline_total=whole_money("shop"), combined_total=whole_money(total),
            online_share_pct=percent_of(F.col("web"), total, 1), mom_online_change_pct=F.col("mom_change_pct"),
        ),
        _grouped(web, "revenue", "by_channel", "channel", whole_money(by("revenue"))),
        _grouped(web, "revenue", "by_category", "category", whole_money(by("revenue"))),
        _grouped(shop, "revenue", "offline_by_region", "region", whole_money(by("revenue"))),
        _figures(
            paid, "media", "value", total_spend=whole_money("spend"),
            blended_roas=round_to(safe_ratio(F.col("incremental"), F.col("spend")), 2),
        ),
        _grouped(spend, "media", "roas_by_channel", "channel", round_to(F.max("roas"), 3)),
        _grouped(spend, "media", "spend_by_channel", "channel", whole_money(by("spend"))),
        _figures(
            deals, "crm", "value", total_leads=F.col("leads"), win_rate_pct=percent_of(F.col("won"), F.col("leads")),
            pipeline_closed_won=whole_money("pipeline"),
            avg_deal_value=whole_money(safe_ratio(F.col("pipeline"), F.col("deals"))),
        ),
        _figures(
            best_and_worst(rated, "lead_source", "win_rate"), "crm", "text",
            top_lead_source=F.col("best"), bottom_lead_source=F.col("worst"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


_DOCUMENT = {
    "period": {"start": "text", "end": "text"},
    "revenue": {
        "online_total": "value", "offline_total": "value", "combined_total": "value", "online_share_pct": "value",
        "mom_online_change_pct": "value", "by_channel": "map", "by_category": "map", "offline_by_region": "map",
    },
    "media": {"total_spend": "value", "blended_roas": "value", "roas_by_channel": "map", "spend_by_channel": "map"},
    "crm": {
        "total_leads": "value", "win_rate_pct": "value", "pipeline_closed_won": "value", "avg_deal_value": "value",
        "top_lead_source": "text", "bottom_lead_source": "text",
    },
}


def _entry(section: str, metric: str, kind: str) -> Column:
    here = (F.col("section") == section) & (F.col("metric") == metric)
    if kind != "map":
        return F.first(F.when(here, F.col(kind)), ignorenulls=True).alias(metric)
    pairs = F.array_sort(F.collect_list(F.when(here, F.struct((-F.col("value")).alias("down"), "name"))))
    entries = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), (-p["down"]).alias("value")))
    return F.map_from_entries(entries).alias(metric)


def build_context(metrics: DataFrame) -> DataFrame:
    """One row: the figures of `context_metrics` as a nested document in `context`."""
    sections = [
        F.struct(*[_entry(section, metric, kind) for metric, kind in figures.items()]).alias(section)
        for section, figures in _DOCUMENT.items()
    ]
    return metrics.agg(*sections).select(
        F.to_json(F.struct(*_DOCUMENT), {"ignoreNullFields": "false"}).alias("context")
    )


_KIND_TYPES = {"value": "double", "text": "string", "map": "map<string,double>"}
_SCHEMA = ", ".join(
    f"{section} struct<{', '.join(f'{m}: {_KIND_TYPES[kind]}' for m, kind in figures.items())}>" for section, figures in _DOCUMENT.items()
)


def context_rows(documents: DataFrame) -> DataFrame:
    """The figures in documents of `build_context`, in the shape of `context_metrics`; absent ones give no row."""
    parsed = F.from_json("context", _SCHEMA)
    none = F.lit(None)

    def row(section: str, metric: str, name: Column, value: Column, text: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(metric).alias("metric"), name.cast("string").alias("name"),
            value.cast("double").alias("value"), text.cast("string").alias("text"),
        )

    def figure(section: str, metric: str, kind: str) -> Column:
        found = F.col("_c")[section][metric]
        if kind == "map":
            return F.transform(F.map_entries(found), lambda e: row(section, metric, e["key"], e["value"], none))
        return F.array(row(section, metric, none, *((found, none) if kind == "value" else (none, found))))

    lists = [figure(section, metric, kind) for section, figures in _DOCUMENT.items() for metric, kind in figures.items()]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast(_ROWS)) for x in lists]))
    rows = documents.select(parsed.alias("_c")).select(F.inline(every))
    return rows.filter(F.coalesce(F.col("value").cast("string"), F.col("text")).isNotNull())


_ROWS = "array<struct<section:string,metric:string,name:string,value:double,text:string>>"

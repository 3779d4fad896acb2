"""Near-duplicate collapse and diversified selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hexapla.config import DEFAULTS, Settings
from hexapla.functions.lineage import cut


def collapse_duplicates(rows: DataFrame, key: list[Column]) -> DataFrame:
    """The first by rank of every query and key; null parts of a key are equal."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = rows.withColumns(dict(zip(names, key, strict=True)))
    w = Window.partitionBy("query_id", *names).orderBy("rank")
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *names)


def duplicate_key(settings: Settings = DEFAULTS) -> list[Column]:
    locator = F.coalesce(F.nullif("chapter_ref", F.lit("")), F.nullif("section_ref", F.lit("")), "section")
    return [F.col("tradition"), locator, F.left(F.coalesce(F.nullif("text_translation", F.lit("")), "text"), F.lit(settings.dedup_prefix))]


def is_functional(rows: DataFrame) -> bool:
    """Whether every source has one tradition, which the closed form needs."""
    return not rows.groupBy("query_id", "source").agg(F.min("tradition").alias("a"), F.max("tradition").alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).head(1)


def select_windows(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Floor, capped fill and relaxed fill as ranks. Needs query_id, source, tradition, floor_no (null: no floor), rank,
    score; adds sel_pos and source_n. A row is eligible within its source's cap; its phase is 0 up to the
    floor of its group, 1 for other eligible rows, 2 beyond the cap."""
    q = ["query_id"]
    rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy(*q, "source").orderBy("rank")))
    rows = rows.withColumn("_ok", F.col("_s") <= settings.per_source)
    rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy(*q, "tradition", "_ok").orderBy("rank")))
    floor = F.col("_ok") & F.col("floor_no").isNotNull() & (F.col("_t") <= settings.min_per_group)
    rows = rows.withColumn("_phase", F.when(floor, 0).when(F.col("_ok"), 1).otherwise(2))
    order = Window.partitionBy(*q).orderBy("_phase", F.when(F.col("_phase") == 0, F.col("floor_no")), "rank")
    kept = rows.withColumn("sel_pos", F.row_number().over(order)).where(F.col("sel_pos") <= settings.top_k)
    final = Window.partitionBy(*q).orderBy(F.desc("score"), "sel_pos")
    return kept.withColumn("source_n", F.row_number().over(final)).drop("_s", "_ok", "_t", "_phase")


def greedy(rows: list[tuple], settings: Settings = DEFAULTS) -> list[int]:
    """Selected places of (source, tradition, floor_no) rows in rank order: one row at a time, phase by phase."""
    taken: list[int] = []
    used: dict = {}

    def take(i: int) -> None:
        taken.append(i)
        used[rows[i][0]] = used.get(rows[i][0], 0) + 1

    floors = sorted({(r[2], r[1]) for r in rows if r[2] is not None})
    for no, group in floors:
        got = 0
        for i, (source, tradition, floor) in enumerate(rows):
            if got == settings.min_per_group or len(taken) == settings.top_k:
                break
            if (floor, tradition) == (no, group) and i not in taken and used.get(source, 0) < settings.per_source:
                take(i)
                got += 1
    for capped in (True, False):
        for i, row in enumerate(rows):
            if len(taken) == settings.top_k:
                return taken
            if i not in taken and (not capped or used.get(row[0], 0) < settings.per_source):
                take(i)
    return taken


def select_greedy(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The same for sources of several traditions; a query's candidates (the pool, of bounded size) are one group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        floor = [None if pd.isna(x) else int(x) for x in g["floor_no"]]
        out = g.iloc[greedy(list(zip(g["source"], g["tradition"], floor, strict=True)), settings)].copy()
        out["sel_pos"] = range(1, len(out) + 1)
        out = out.sort_values(["score", "sel_pos"], ascending=[False, True])
        out["source_n"] = range(1, len(out) + 1)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sel_pos int, source_n int"
    return rows.groupBy("query_id").applyInPandas(run, schema)


def diversify(rows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """`rows` are materialised once, as the choice between both ways reads them too."""
    rows = cut(rows)
    return select_windows(rows, settings) if is_functional(rows) else select_greedy(rows, settings)

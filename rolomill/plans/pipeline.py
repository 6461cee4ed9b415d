"""The task graph: registry, order, run and report, and the standard contact pipeline on it.

Tasks pass lazily evaluated DataFrames to each other; a task's result is staged in the shared folder only where the plan would be computed again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import columns, consolidate, dedup, enrich, export, search
from ..sources import files, manifest
from .staging import stage


@dataclass
class PipelineConfig:
    source: str = ""
    output: str = ""
    compat_nan: bool = False
    max_candidates: int | None = None
    #: Optional hook: (headers, first rows) -> column mapping, or a text with it (columns.parse_reply); None or an empty answer means the deterministic rules.
    map_hook: Callable[[list[str], list[list[str | None]]], dict[str, str] | str | None] | None = None
    #: (row_id, html), or (page_id, url, html) to be linked with contacts.
    pages: DataFrame | None = None
    #: How pages are linked: by names (first and last name as neighbours), or by search (names and company, best pages first).
    find: str = "names"
    #: Whether each export is one file.
    one_file: bool = False


@dataclass
class Task:
    run: Callable[[Context], Any]
    needs: tuple[str, ...] = ()
    critical: bool = True
    #: How often a failed run is tried again, after 1, 2, 4, ... seconds, at most 30.
    retries: int = 0


@dataclass
class Context:
    spark: SparkSession
    config: PipelineConfig
    results: dict[str, Any] = field(default_factory=dict)
    #: Figures that tasks leave for the report.
    counts: dict[str, Any] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, task: str) -> Any:
        return self.results[task]


class Pipeline:
    """A registry of tasks that runs them in the order of their needs."""

    def __init__(self, tasks: dict[str, Task] | None = None):
        self.tasks: dict[str, Task] = dict(tasks or {})

    def register(self, name: str, run: Callable[[Context], Any], needs: tuple[str, ...] = (), critical: bool = True, retries: int = 0) -> Pipeline:
        self.tasks[name] = Task(run, needs, critical, retries)
        return self

    def order(self) -> list[str]:
        for name, t in self.tasks.items():
            if unknown := set(t.needs) - set(self.tasks):
                raise ValueError(f"{name} needs unknown tasks: {', '.join(sorted(unknown))}")
        try:
            return list(TopologicalSorter({n: t.needs for n, t in self.tasks.items()}).static_order())
        except CycleError as e:
            raise ValueError(f"tasks need each other: {e.args[1]}") from e

    def run(self, spark: SparkSession, config: PipelineConfig | None = None) -> tuple[Context, dict]:
        """(context, report). A failed critical task ends the run; tasks that need a failed one are skipped. The report goes to the output folder as JSON, if there is one."""
        ctx, steps, start = Context(spark, config or PipelineConfig()), {}, time.time()
        order = self.order()
        for name in order:
            t, began = self.tasks[name], time.time()
            if lacking := [n for n in t.needs if n not in ctx.results]:
                steps[name] = {"status": "skipped", "lacks": lacking}
                continue
            for attempt in range(t.retries + 1):
                try:
                    ctx.results[name] = t.run(ctx)
                    steps[name] = {"status": "completed"}
                    break
                except Exception as e:
                    steps[name] = {"status": "failed", "error": str(e)}
                    if attempt < t.retries:
                        time.sleep(min(2**attempt, 30))
            steps[name] |= {"seconds": round(time.time() - began, 3)}
            if steps[name]["status"] == "failed" and t.critical:
                break
        done = [n for n, x in steps.items() if x["status"] == "completed"]
        report = {
            "status": "success" if len(done) == len(self.tasks) else "partial_success",
            "total_seconds": round(time.time() - start, 3),
            "tasks_registered": len(self.tasks), "tasks_completed": len(done), "success_rate": 100 * len(done) / max(1, len(self.tasks)),
            "order": order, "tasks": steps, "statistics": ctx.counts, "output_files": ctx.outputs,
        }
        if ctx.config.output:
            spark.createDataFrame([(files.to_json(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{ctx.config.output}/report")
        return ctx, report


#: Quality of a sheet that the deterministic rules map.
RULES = 70.0


def _convert(ctx: Context) -> DataFrame:
    cells, failed = files.load(ctx.spark, ctx.config.source)
    ctx.counts["failed_files"] = failed.count()
    if ctx.config.output:
        files.write_report(files.verify(cells, failed), f"{ctx.config.output}/verification")
    return cells


def _hooked(heads: DataFrame, cells: DataFrame, hook) -> tuple[DataFrame, DataFrame]:
    """(sheet, col_name, target) where the hook has an answer, and (sheet, score) where it gives one.

    Sheets with equal names of columns are asked for once, with the first rows of the first of them; tasks call the hook, so it must be serialisable.
    """
    marked = stage(heads.select("sheet", "names", F.sha2(F.to_json(F.struct("names")), 256).alias("mark")))
    first = marked.groupBy("mark").agg(F.min_by("names", "sheet").alias("names"), F.min("sheet").alias("sheet"))
    rows = cells.where(F.col("row_id") < columns.SAMPLES).groupBy("sheet", "row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
    rows = rows.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row_id", "cells"))).alias("rows"))  # SAMPLES rows of a sheet

    def ask(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for mark, names, first_rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mapping, score = columns.parse_reply(hook(names, [[c["value"] for c in r["cells"]] for r in first_rows or []]))
                for x, v in zip(out, (mark, [(c, t) for c, t in mapping.items() if c in names], score), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.map_(pa.string(), pa.string())), pa.array(out[2], pa.float64())], ["mark", "mapping", "score"])

    asked = first.join(rows, "sheet", "left").select("mark", "names", "rows")
    answers = stage(asked.mapInArrow(ask, "mark string, mapping map<string,string>, score double"))
    told = marked.select("sheet", "mark").join(answers, "mark")
    return told.select("sheet", F.explode("mapping").alias("col_name", "target")), told.where("score is not null").select("sheet", "score")


def _map_sheets(ctx: Context) -> DataFrame:
    """(sheet, row_id, eight fields) of all sheets. Headers, profiles and mappings of all sheets are found together."""
    grid = ctx["convert"].select(F.concat_ws("#", "file", F.when(F.col("sheet") != "", F.col("sheet"))).alias("sheet"), "row_idx", "cells")
    heads = stage(columns.headers(grid))
    n = heads.count()
    cells = columns.table_cells(grid, heads, n)
    by, scored = ("sheet",), None
    mapping = columns.map_columns(cells, by)
    if ctx.config.map_hook:
        told, scores = _hooked(heads, cells, ctx.config.map_hook)
        scored = scores.agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total")).first()
        told = columns.valid_mapping(told)
        mapping = told.unionByName(mapping.join(told.select("sheet").distinct(), "sheet", "left_anti"))
    mapping = stage(columns.valid_mapping(mapping))
    chosen = stage(columns.best_columns(columns.column_quality(cells, mapping, by), by))
    # a sheet that the rules map counts RULES
    told_n, total = (scored.n, scored.total) if scored else (0, 0.0)
    ctx.counts |= {"sheets": n, "data_quality_score": (total + RULES * (n - told_n)) / max(1, n)}
    return columns.standardize_sheets(grid, heads, chosen, n)


def _consolidate(ctx: Context) -> DataFrame:
    t = ctx["map"].withColumn("file", F.element_at(F.split("sheet", "/"), -1))
    kept = consolidate.valuable(consolidate.clean(consolidate.align(t, F.col("file"), keep=("sheet", "row_id"))))
    # place in the file orders the rows of a sheet, its number among the sheets the sheets; no global sort is needed
    order = kept.select("sheet").distinct().withColumn("no", F.row_number().over(Window.orderBy("sheet")))
    return stage(kept.join(order, "sheet").withColumn("row_id", F.col("no").cast("long") * (1 << 40) + F.col("row_id")).drop("sheet", "no"))


def _dedup(ctx: Context) -> DataFrame:
    df, c = ctx["consolidate"], ctx.config
    if c.max_candidates is None:
        gone = dedup.removed(df, c.compat_nan)
    else:
        gone = dedup.merges(dedup.confirmed(dedup.candidates(df, dedup.THRESHOLD, c.compat_nan, c.max_candidates)))
    gone = stage(gone)
    ctx.counts |= {"initial_count": df.count(), "merged_count": gone.count()}
    return stage(dedup.merged(df, gone))


def _enrich(ctx: Context) -> DataFrame:
    """Each page is parsed once, before it meets contacts: text and addresses move, not HTML. Staged, as every export reads it."""
    df, pages, c = ctx["dedup"], ctx.config.pages, ctx.config
    if pages is None:
        return df
    if "row_id" in pages.columns:
        found = pages.select("row_id", enrich.page_emails(F.col("html")).alias("emails"))
    else:
        parsed = stage(enrich.pages(pages, limit=None))
        linked = search.search(df, parsed) if c.find == "search" else enrich.linked_pages(df, parsed)
        found = linked.select("row_id", "page_id").join(parsed.where("size(emails) > 0").select("page_id", "emails"), "page_id")
    found = found.select("row_id", F.explode("emails").alias("e")).groupBy("row_id").agg(F.array_sort(F.collect_set("e")).alias("emails"))
    found = found.join(df.select("row_id", "first_name", "last_name"), "row_id").select("row_id", enrich.best_email(F.col("emails"), F.col("first_name"), F.col("last_name")).alias("new_email"))
    return stage(enrich.update_emails(df, found))


def _export(ctx: Context) -> dict[str, DataFrame]:
    """Files are written in parallel, and read again: rows that aren't as they were written are counted for the report."""
    out = {"standard": export.standard(ctx["enrich"]), "apollo": export.apollo(ctx["enrich"]), "hubspot": export.hubspot(ctx["enrich"])}
    if ctx.config.output:
        n = manifest.buckets_for(ctx["enrich"].count())
        for name, df in out.items():
            ctx.outputs[name] = f"{ctx.config.output}/{name}"
            files.write_csv(df, ctx.outputs[name], ctx.config.one_file)
            ctx.counts[f"{name}_differences"] = manifest.differing(manifest.manifest(df, n), manifest.manifest(files.read_csv(ctx.spark, ctx.outputs[name]), n)).count()
    return out


def standard_pipeline() -> Pipeline:
    """convert -> map -> consolidate -> dedup -> enrich -> export."""
    p = Pipeline()
    p.register("convert", _convert)
    p.register("map", _map_sheets, ("convert",)).register("consolidate", _consolidate, ("map",)).register("dedup", _dedup, ("consolidate",))
    return p.register("enrich", _enrich, ("dedup",), critical=False).register("export", _export, ("enrich",))

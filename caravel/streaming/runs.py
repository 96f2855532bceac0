"""One run over the dependent loads: products, then orders and their lines, and web events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.lake import Lake, ago, error_text, now
from caravel.operators.profile import tagged_counts
from caravel.plans import staging
from caravel.sources import versions
from caravel.streaming import feeds

# Each load and the load it has to follow, in the order they are run.
AFTER = {"products": None, "orders": "products", "order_items": "orders", "web_events": "products"}

STAGED = ("customers", "products", "orders", "order_items", "web_events")


def _refresh_reference(lake: Lake, table: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a reference table as a whole: a new folder, to which readers move once it is logged.

    A load that fails leaves the old one in place.  Rows of a version that is in already are not written again.
    """
    version = versions.current_version(lake, table)
    name = f"v{version:08d}"
    if lake.current_load(table) == name:
        return
    rows = staging.stamped(build(versions.as_of(lake, table, version)))
    rows.write.mode("overwrite").parquet(f"{lake.staging(table)}/_load={name}")
    lake.append_log("batches", table_name=table, src_batch=name, written_at=now(), through_version=version)


def refresh_products(lake: Lake) -> None:
    """Replace the products, and label lines that were there before theirs."""
    _refresh_reference(lake, "products", staging.products)
    feeds.label_late_lines(lake)


def refresh_customers(lake: Lake) -> None:
    _refresh_reference(lake, "customers", staging.customers)


def _load(lake: Lake, job: str, run_id: int, max_files: int | None) -> str | None:
    """Run one load; returns the state to log, or ``None`` when the load has logged itself."""
    if job == "products":
        refresh_products(lake)
        return "SUCCEEDED"
    at = feeds.position(lake, job)
    if not at.has_data:
        return "SKIPPED"
    feeds.consume(lake, job, run_id, at, max_files)
    return None


def run_loads(lake: Lake, max_files: int | None = None) -> int:
    """Run the loads in order and log each; returns the run number.

    A load without new rows is skipped, and what depends on it still looks at its own input.  After
    a failure the loads that depend on the failed one are cancelled, the others still run, and the
    first error is raised at the end. Logs that have gathered many files are merged after a run without errors.
    """
    run_id = lake.log("runs").agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0] + 1
    errors: list[Exception] = []
    stopped: set[str] = set()
    for job, earlier in AFTER.items():
        started = lake.clock()
        message = None
        if earlier in stopped:
            state = "CANCELLED"
        else:
            try:
                state = _load(lake, job, run_id, max_files)
            except Exception as error:
                errors.append(error)
                state, message = "FAILED", error_text(error)
        if state in ("CANCELLED", "FAILED"):
            stopped.add(job)
        if state is not None:
            lake.append_log(
                "runs", run_id=run_id, job=job, state=state, error_message=message,
                scheduled_time=started, completed_time=now(),
            )
    if errors:
        raise errors[0]
    from caravel.sources import merging  # it looks at the feeds, too

    merging.merge_logs(lake, merging.FAN)
    return run_id


def history(lake: Lake, hours: int = 1, rows: int | None = 20, since: datetime | None = None) -> DataFrame:
    """Newest jobs of the last hours, or since a moment; all of them where ``rows`` is None."""
    start = ago(hours, "HOURS") if since is None else F.lit(since).cast("timestamp_ntz")
    recent = lake.log("runs").where(F.col("scheduled_time") >= start)
    ordered = recent.orderBy(F.col("scheduled_time").desc(), F.col("job"))
    return ordered if rows is None else ordered.limit(rows)


def staged_counts(lake: Lake, phase: str, tables: tuple[str, ...] = feeds.FEEDS) -> DataFrame:
    """Rows per STAGING table, tagged with a phase (before, after)."""
    counts = tagged_counts({t: lake.staged(t) for t in tables})
    return counts.select(F.lit(phase).alias("phase"), "table_name", "row_count")

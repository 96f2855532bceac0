"""Declared column lists of every table.  Nothing is inferred when files are read."""

from __future__ import annotations

RAW = {
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_date": "timestamp_ntz",
        "status": "string",
        "total_amount": "decimal(12,2)",
    },
    "order_items": {
        "order_id": "string",
        "product_id": "string",
        "quantity": "bigint",
        "unit_price": "decimal(12,2)",
    },
    "customers": {
        "customer_id": "string",
        "email": "string",
        "first_name": "string",
        "last_name": "string",
        "city": "string",
        "signup_date": "date",
    },
    "products": {"data": "variant"},
    "web_events": {"data": "variant"},
}

# Every RAW row carries when and from which file it came.
AUDIT = {"_loaded_at": "timestamp_ntz", "_source_file": "string"}

# Directory columns of a RAW table: the write that added the row, and what kind of write it was.
VERSIONED = {"_version": "int", "_change": "string"}

STAGING = {
    "customers": {
        "customer_id": "string",
        "email": "string",
        "first_name": "string",
        "last_name": "string",
        "city": "string",
        "signup_date": "date",
    },
    "products": {
        "product_id": "string",
        "name": "string",
        "category": "string",
        "brand": "string",
        "price": "decimal(10,2)",
        "color": "string",
        "warranty_months": "bigint",
        "weight_g": "bigint",
        "nb_tags": "bigint",
    },
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_ts": "timestamp_ntz",
        "order_date": "date",
        "status": "string",
        "total_amount": "decimal(12,2)",
    },
    "order_items": {
        "order_id": "string",
        "product_id": "string",
        "quantity": "bigint",
        "unit_price": "decimal(12,2)",
        "line_amount": "decimal(14,2)",
        "product_name": "string",
        "category": "string",
        "brand": "string",
    },
    "web_events": {
        "event_id": "string",
        "user_id": "string",
        "is_anonymous": "boolean",
        "session_id": "string",
        "event_type": "string",
        "product_id": "string",
        "event_ts": "timestamp_ntz",
        "event_date": "date",
        "device": "string",
        "referrer": "string",
        "ip": "string",
    },
}

# STAGING tables that each load replaces as a whole.
REFERENCE = ("products", "customers")

# STAGING tables laid out by month: the folder column and the day it follows from.
BY_MONTH = {"orders": ("order_month", "order_date"), "web_events": ("event_month", "event_date")}

# STAGING lines are laid out by whether their product has still to come.
LATE = {"_late": "int"}

# What the catalogue says of products whose lines were there first, for the lines of batches after one and up to another.
LABELS = {
    "product_id": "string",
    "product_name": "string",
    "category": "string",
    "brand": "string",
    "_after": "string",
    "_through": "string",
}

STAMP = {"stg_loaded_at": "timestamp_ntz"}

LOGS = {
    # one row per write to a RAW table (also the load history)
    "commits": {
        "table_name": "string",
        "version": "int",
        "action": "string",
        "committed_at": "timestamp_ntz",
        "file_name": "string",
        "status": "string",
        "row_count": "bigint",
        "row_parsed": "bigint",
        "first_error_message": "string",
    },
    # one row per (re)start of a change feed
    "feeds": {"feed": "string", "generation": "int", "start_version": "int", "created_at": "timestamp_ntz"},
    # one row per micro-batch of a feed (without src_batch when its commits brought no new rows), per load of a reference table
    # and per look for late products (without src_batch when none had come; through_batch is the last batch of lines it covers)
    "batches": {
        "table_name": "string",
        "src_batch": "string",
        "row_count": "bigint",
        "written_at": "timestamp_ntz",
        "generation": "int",
        "through_version": "int",
        "through_batch": "string",
    },
    # one row per job of an ordered run
    "runs": {
        "run_id": "int",
        "job": "string",
        "state": "string",
        "generation": "int",
        "through_version": "int",
        "row_count": "bigint",
        "scheduled_time": "timestamp_ntz",
        "completed_time": "timestamp_ntz",
        "error_message": "string",
    },
    # one row per mart refresh
    "refreshes": {
        "mart": "string",
        "refresh": "int",
        "action": "string",
        "state": "string",
        "through_batch": "string",
        "data_timestamp": "timestamp_ntz",
        "start_time": "timestamp_ntz",
        "end_time": "timestamp_ntz",
    },
}


def ddl(*column_groups: dict[str, str]) -> str:
    """``name type, ...`` text for readers, from one or more column groups."""
    return ", ".join(f"`{name}` {kind}" for group in column_groups for name, kind in group.items())


def names(table: dict[str, str]) -> list[str]:
    return list(table)

"""Spark jobs of one call, found again by a tag."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, wait

from pyspark import SparkContext


def tagged(tag: str, pool: str | None, f: Callable, *args):
    """Calls f so that the jobs it starts in this thread carry the tag, and go to the pool."""
    sc = SparkContext._active_spark_context
    if sc is None:
        return f(*args)
    sc.addJobTag(tag)
    was = sc.getLocalProperty("spark.scheduler.pool")
    if pool:
        sc.setLocalProperty("spark.scheduler.pool", pool)
    try:
        return f(*args)
    finally:
        sc.removeJobTag(tag)
        if pool:
            sc.setLocalProperty("spark.scheduler.pool", was)


def cancel_jobs(tag: str) -> None:
    """Cancels what runs under a tag."""
    sc = SparkContext._active_spark_context
    if sc is not None:
        sc.cancelJobsWithTag(tag)


def cancel_until_done(tag: str, call: Future) -> None:
    """Cancels, without waiting for it, what runs and what a late call still starts."""

    def run():
        while not call.done():
            cancel_jobs(tag)
            wait([call], timeout=0.5)

    threading.Thread(target=run, daemon=True).start()

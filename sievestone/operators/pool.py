"""Independent Spark jobs submitted from a few threads of the driver."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

POOL = 8


def together(jobs: list[Callable], threads: int = POOL) -> list:
    """Results of all jobs, in order. The first error is raised after the running jobs have ended; jobs not begun are dropped."""
    if len(jobs) < 2 or threads < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=min(threads, len(jobs))) as pool:
        futures = [pool.submit(job) for job in jobs]
        try:
            return [f.result() for f in futures]
        except BaseException:
            for f in futures:
                f.cancel()
            raise

"""Flows: query and process nodes one after the other, each sees the results before it.

Also waves: numbered tasks that run together, one number after the other.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame

from ..functions.jobs import cancel_jobs, tagged
from ..sources.catalog import Catalog
from .bind import bind
from .compile import Query


class Flow:
    """nodes: [{name, query | process, args, outs}]; output: a template over $in, $res, $global, $out."""

    def __init__(self, name: str, catalog: Catalog, nodes: list[dict], output=None, processes: dict[str, Callable] | None = None):
        self.name, self.catalog, self.nodes, self.output, self.processes = name, catalog, nodes, output, processes or {}

    def run(self, *args, glob: dict | None = None):
        data: dict = {"$in": list(args), "$res": {}, "$out": {}, "$global": glob or {}}
        if args and isinstance(args[0], dict):
            data |= {f"${k}": v for k, v in args[0].items()}
        result = None
        for node in self.nodes:
            if node.get("process") == f"flows.{self.name}":
                raise ValueError("a flow does not call itself")
            if "query" in node:
                result = Query(self.catalog, node["query"]).frame(_plain(data))
                self.catalog.register(node["name"], result)
            else:
                result = self.processes[node["process"]](*bind(node.get("args") or [], _plain(data)))
            data["$res"][node["name"]] = result
            outs = node.get("outs")
            data["$out"][node["name"]] = bind(outs, _plain(data)) if outs is not None else result
        return bind(self.output, _plain(data)) if self.output is not None else result


def _plain(data: dict) -> dict:
    """Results that are tables are not bound into text; nodes read them as tables by their node's name."""
    def cut(x):
        return {k: cut(v) for k, v in x.items()} if isinstance(x, dict) else x

    return {**cut(data), **{k.lstrip("$"): v for k, v in data.items() if not isinstance(v, DataFrame)}}


CREATED, RUNNING, PAUSED, COMPLETED, FAILED, DESTROYED = "created", "running", "paused", "completed", "failed", "destroyed"


class Stopped(RuntimeError):
    """The plan was stopped, or a task of the same wave failed."""


class Plan:
    """Tasks by order: those of one order are a wave and run at once, one wave after the other.

    A task is called with the plan's shared values, a dict. The first failure of a wave
    stops the plan: tasks that have not begun do not, and the Spark jobs of those that
    run are cancelled by their tag, each task's jobs having one of its own and a pool
    (for spark.scheduler.mode FAIR). pause() lets what runs end, and nothing else begin,
    until resume(); stop() cancels.
    """

    def __init__(self, name: str = "plan", workers: int = 8, pool: str | None = None):
        self.name, self.workers, self.pool = name, workers, pool
        self.shared: dict = {}
        self.status = CREATED
        self.tasks: dict[str, dict] = {}
        self._go, self._lock, self._end = threading.Event(), threading.RLock(), None
        self._go.set()

    def add(self, task: str, order: int, run: Callable) -> "Plan":
        with self._lock:
            if task in self.tasks:
                raise ValueError(f"task {task} is there")
            self.tasks[task] = {"order": order, "run": run, "status": CREATED, "tag": f"{self.name}-{uuid.uuid4().hex}", "result": None, "error": None}
        return self

    def remove(self, task: str) -> None:
        with self._lock:
            if self.tasks[task]["status"] == RUNNING:
                raise ValueError(f"task {task} runs")
            del self.tasks[task]

    def task_status(self, task: str) -> str:
        return self.tasks[task]["status"]

    def start(self) -> dict:
        """Results by task, when all waves have ended; the first error, where one failed."""
        with self._lock:
            if self.status in (RUNNING, PAUSED):
                raise ValueError("the plan runs")
            self.status = RUNNING
            self._end = None
            for t in self.tasks.values():
                t.update(status=CREATED, result=None, error=None)
        try:
            for order in sorted({t["order"] for t in self.tasks.values()}):
                self._wave([t for t in self.tasks.values() if t["order"] == order])
        except BaseException:
            self.status = DESTROYED if self.status == DESTROYED else FAILED
            raise
        self.status = COMPLETED
        return {name: t["result"] for name, t in self.tasks.items()}

    def _wave(self, wave: list[dict]) -> None:
        with ThreadPoolExecutor(self.workers) as pool:
            running: dict[Future, dict] = {pool.submit(self._one, t): t for t in wave}
            left, error = set(running), None
            while left:
                done, left = wait(left, timeout=0.5, return_when=FIRST_COMPLETED)
                bad = next((f.exception() for f in done if not f.cancelled() and f.exception()), None)
                if bad is not None and error is None:
                    error = self._end = self._end or bad
                if self._end is not None:
                    # again and again: a task may be about to start another job
                    for f in left:
                        f.cancel()
                    self._cancel(wave)
            if error is not None:
                raise error

    def _one(self, task: dict):
        self._go.wait()
        if self._end is not None:
            raise Stopped(f"{self.name} has stopped")
        task["status"] = RUNNING
        try:
            task["result"] = tagged(task["tag"], self.pool, task["run"], self.shared)
            task["status"] = COMPLETED
        except BaseException as e:
            self._end = self._end or e  # before this worker takes another task
            task.update(status=FAILED, error=e)
            raise

    @staticmethod
    def _cancel(tasks) -> None:
        for t in tasks:
            if t["status"] == RUNNING:
                cancel_jobs(t["tag"])

    def pause(self) -> None:
        with self._lock:
            if self.status != RUNNING:
                raise ValueError("the plan does not run")
            self._go.clear()
            self.status = PAUSED

    def resume(self) -> None:
        with self._lock:
            if self.status != PAUSED:
                raise ValueError("the plan is not paused")
            self.status = RUNNING
            self._go.set()

    def stop(self) -> None:
        with self._lock:
            self._end = Stopped(f"{self.name} was stopped")
            self.status = DESTROYED
            self._cancel(self.tasks.values())
            self._go.set()


def waves(tasks: list[tuple[int, Callable]], workers: int = 8) -> list:
    """Results of (order, task), by order: equal orders run at once, the first failure stops what has not begun and cancels the Spark jobs of what runs."""
    plan = Plan(workers=workers)
    for i, (order, task) in enumerate(tasks):
        plan.add(str(i), order, lambda _, task=task: task())
    found = plan.start()
    return [found[str(i)] for i in sorted(range(len(tasks)), key=lambda i: tasks[i][0])]

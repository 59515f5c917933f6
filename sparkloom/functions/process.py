"""Named processes: a registry of handlers, called by dotted names."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from .jobs import cancel_until_done, tagged


class Processes:
    def __init__(self):
        self._found: dict[str, Callable] = {}

    def register(self, name: str, handler: Callable) -> None:
        self._found[name.lower()] = handler

    def register_group(self, group: str, handlers: dict[str, Callable]) -> None:
        for name, handler in handlers.items():
            self.register(f"{group}.{name}", handler)

    def unregister(self, name: str) -> None:
        self._found.pop(name.lower(), None)

    def alias(self, name: str, other: str) -> None:
        self._found[other.lower()] = self._found[name.lower()]

    def exists(self, name: str) -> bool:
        return self.resolve(name) is not None

    def resolve(self, name: str) -> tuple[Callable, list[str]] | None:
        """The handler of a name, or that of group.method with what stands between as its first argument: models.user.pet.Find."""
        low = name.lower()
        if low in self._found:
            return self._found[low], []
        parts = name.split(".")
        if len(parts) >= 3 and (k := f"{parts[0]}.{parts[-1]}".lower()) in self._found:
            return self._found[k], [".".join(parts[1:-1])]
        return None

    def run(self, name: str, *args, timeout: float | None = None):
        found = self.resolve(name)
        if found is None:
            raise KeyError(f"no process {name}")
        handler, first = found
        if timeout is None:
            return handler(*first, *args)
        pool, tag = ThreadPoolExecutor(1), f"process-{uuid.uuid4().hex}"
        call = pool.submit(tagged, tag, None, handler, *first, *args)
        try:
            return call.result(timeout)
        except TimeoutError:
            cancel_until_done(tag, call)  # a handler that is late is not waited for, its Spark jobs end
            raise
        finally:
            pool.shutdown(wait=False, cancel_futures=True)


def model_processes(models) -> dict[str, Callable]:
    return {
        "find": models.find, "get": models.get, "paginate": models.paginate, "count": models.count, "create": models.insert, "insert": models.insert, "updatewhere": models.update_where, "destroywhere": models.destroy_where, "deletewhere": models.delete_where, "upsert": models.upsert,
        "selectoption": models.select_option, "read": lambda name: models.found[name], "exists": lambda name: name in models.found,
    }


def pluck(rows, column: str) -> list:
    return [r[column] for r in rows]


class Args:
    """Arguments of a process by place, as a type; what is not there or cannot be one is the default, or without one an error."""

    _NONE = object()

    def __init__(self, *values):
        self.values = values

    def _get(self, i: int, kind: str, f: Callable, default):
        try:
            return f(self.values[i])
        except (IndexError, TypeError, ValueError):
            if default is not Args._NONE:
                return default
            raise ValueError(f"argument {i + 1} is no {kind}") from None

    def need(self, n: int) -> None:
        if len(self.values) < n:
            raise ValueError(f"{n} arguments are needed, {len(self.values)} given")

    def integer(self, i: int, default=_NONE) -> int:
        return self._get(i, "integer", lambda v: int(float(v)) if isinstance(v, str) and "." in v else int(v), default)

    def string(self, i: int, default=_NONE) -> str:
        def text(v):
            if v is None:
                raise ValueError
            return str(v).lower() if isinstance(v, bool) else str(v)

        return self._get(i, "string", text, default)

    def boolean(self, i: int, default=_NONE) -> bool:
        def truth(v):
            if isinstance(v, str):
                return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False, "": False}.get(v.lower(), True)
            return bool(v)

        return self._get(i, "truth value", truth, default)

    def mapping(self, i: int, default=_NONE) -> dict:
        import json

        def pairs(v):
            v = json.loads(v) if isinstance(v, str) else v.asDict(True) if hasattr(v, "asDict") else v
            if not isinstance(v, dict):
                raise ValueError
            return v

        return self._get(i, "map", pairs, default)

    def array(self, i: int, default=_NONE) -> list:
        import json

        def items(v):
            v = json.loads(v) if isinstance(v, str) else v
            if not isinstance(v, (list, tuple)):
                raise ValueError
            return list(v)

        return self._get(i, "list", items, default)

    def strings(self, i: int, default=_NONE) -> list[str]:
        def texts(v):
            return [str(x) for x in v] if isinstance(v, (list, tuple)) else [str(v)]

        return self._get(i, "list of strings", texts, default)

    def records(self, i: int, default=_NONE) -> list[dict]:
        found = self.array(i, default)
        rows = [r.asDict(True) if hasattr(r, "asDict") else r for r in found]
        if not all(isinstance(r, dict) for r in rows):
            raise ValueError(f"argument {i + 1} is no list of records")
        return rows

    def query(self, i: int, default=_NONE) -> dict:
        """A query parameter: a map, or a URL's query text."""
        from ..operators.model import url_param

        v = self.values[i] if i < len(self.values) else None
        return url_param(v) if isinstance(v, str) and not v.lstrip().startswith("{") else self.mapping(i, default)


def user_function(spark, name: str, f: Callable, returns: str):
    """Makes a Python function of columns (pandas Series in, one Series out, by Arrow batches) callable by name in documents and SQL."""
    from pyspark.sql import functions as F

    return spark.udf.register(name, F.pandas_udf(f, returns))

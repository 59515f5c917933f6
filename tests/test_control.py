"""Plans and processes whose Spark jobs end with them; JSON repair."""

import threading
import time

import pytest

from sparkloom.functions.process import Processes
from sparkloom.functions.text import repair_json
from sparkloom.plans.flow import Plan, Stopped, waves


def slow(spark, seconds=60):
    """A Spark job that takes so long."""

    def run(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return lambda *_: spark.range(1).mapInArrow(run, "id long").collect()


def active(spark):
    return spark.sparkContext.statusTracker().getActiveJobsIds()


def fails(after=0.0):
    def run(*_):
        time.sleep(after)
        raise KeyError("bad")

    return run


def settled(spark, within=15):
    end = time.time() + within
    while active(spark) and time.time() < end:
        time.sleep(0.2)
    return not active(spark)


def test_waves_in_order_with_shared_values():
    plan, seen = Plan(), []
    plan.add("b", 2, lambda shared: shared["a"] + 1).add("a", 1, lambda shared: shared.setdefault("a", 1)).add("c", 2, lambda shared: seen.append(1))
    assert plan.start() == {"a": 1, "b": 2, "c": None} and plan.status == "completed" and plan.task_status("b") == "completed"
    assert waves([(2, lambda: "b"), (1, lambda: "a"), (2, lambda: "c")]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        plan.add("a", 1, lambda s: 0)
    plan.remove("c")
    assert set(plan.start()) == {"a", "b"}


def test_failure_stops_the_wave_and_its_jobs(spark):
    ran = []
    plan = Plan(workers=2)
    plan.add("long", 1, slow(spark)).add("bad", 1, fails(3))
    for i in range(40):
        plan.add(f"later{i}", 1, lambda s: (time.sleep(0.1), ran.append(1)))
    plan.add("next", 2, lambda s: ran.append(2))
    t = time.time()
    with pytest.raises(KeyError):
        plan.start()
    assert time.time() - t < 40 and plan.status == "failed" and settled(spark)
    assert plan.task_status("bad") == plan.task_status("long") == "failed" and plan.task_status("next") == "created"
    assert ran == []


def test_pause_resume_and_stop(spark):
    plan, ran = Plan(), []
    hold = threading.Event()
    plan.add("one", 1, lambda s: hold.wait(20)).add("two", 2, lambda s: ran.append(1)).add("three", 3, slow(spark))
    out = []
    thread = threading.Thread(target=lambda: out.append(pytest.raises(Exception, plan.start)))
    thread.start()
    time.sleep(0.5)
    plan.pause()
    hold.set()
    time.sleep(1)
    assert plan.task_status("one") == "completed" and ran == [] and plan.status == "paused"
    plan.resume()
    while not active(spark):
        time.sleep(0.1)
    assert ran == [1]
    plan.stop()
    thread.join(30)
    assert not thread.is_alive() and plan.status == "destroyed" and settled(spark)
    with pytest.raises(ValueError):
        plan.pause()
    assert issubclass(Stopped, RuntimeError)


def test_late_process_ends_its_jobs(spark):
    found = Processes()
    found.register("x.slow", slow(spark))
    with pytest.raises(TimeoutError):
        found.run("x.slow", timeout=3)
    assert settled(spark)
    found.register("x.fast", lambda: spark.range(3).count())
    assert found.run("x.fast", timeout=60) == 3


@pytest.mark.parametrize(("text", "value"), [
    ("{'a': \"it's\"}", {"a": "it's"}), ('{"a": [1, {"b": 2]}', {"a": [1, {"b": 2}]}), ("{'k': 'it\\'s', n: None, t: True,}", {"k": "it's", "n": None, "t": True}), ('{"u": "http://x" // c\n}', {"u": "http://x"}), ("[1 2,, three", [1, 2, "three"]), ('{"a":', {"a": None}), ('{"a": "q \\" w"}', {"a": 'q " w'}), ("{'a': 'x \"y\"'}", {"a": 'x "y"'}), ("[1]]", [1]),
])
def test_repaired_json(text, value):
    assert repair_json(text) == value


def test_json_beyond_repair():
    for text in ("", "}", ",:"):
        with pytest.raises(ValueError):
            repair_json(text)

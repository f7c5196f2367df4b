"""A build run: steps whose outputs are tables, each computed once, reused by all later steps, and published together.

A step names the steps that it needs and gets their tables, read back from files. Steps without open needs run side by side. A step that is
done leaves a marker; a run that is started again under its name takes the tables of marked steps as they are and goes on after them.
Only when all steps are done does one commit swap in all tables; a step that fails keeps the steps that need it from running, lets others
finish, and nothing is published. The run's name stands for its input: a run that continues must read what it read before."""

from __future__ import annotations

import graphlib
import json
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.store import Store


@dataclass(frozen=True)
class Step:
    """make(*tables of needs) gives the step's table."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    """state: done, reused (from an earlier try), failed or skipped (a step that it needs failed)."""

    name: str
    state: str
    rows: int | None = None
    seconds: float = 0.0
    error: str | None = None


class BuildError(RuntimeError):
    """Some steps failed and nothing was published; outcomes has every step's."""

    def __init__(self, outcomes: list[Outcome]) -> None:
        self.outcomes = outcomes
        super().__init__("; ".join(f"{o.name}: {o.error}" for o in outcomes if o.state == "failed"))


def ordered(steps: list[Step]) -> graphlib.TopologicalSorter:
    """The steps by need; names that are unknown or used twice are an error, and so are circles."""
    names = [s.name for s in steps]
    if len(set(names)) < len(names):
        raise ValueError(f"steps of one name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    if unknown := {n for s in steps for n in s.needs} - set(names):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    graph = graphlib.TopologicalSorter({s.name: s.needs for s in steps})
    graph.prepare()
    return graph


def run(store: Store, steps: list[Step], name: str, marks: dict[str, str] | None = None, side_by_side: int = 3) -> list[Outcome]:
    """Run all steps under a run's name and publish their tables, with marks of sources if there are any; what became of each step, in the order of steps."""
    graph, by_name = ordered(steps), {s.name: s for s in steps}
    base = store.head()
    if name in base.runs:
        return [Outcome(s.name, "reused") for s in steps]
    store.begin(name)
    marker = lambda step: f"{store.root}/_runs/{name}/{step}.json"
    entries: dict[str, dict] = {}
    outcomes: dict[str, Outcome] = {}

    def one(step: Step) -> Outcome:
        began = time.time()
        if store.files.exists(marker(step.name)):
            left = json.loads(store.files.read(marker(step.name)))
            entries[step.name] = left["table"]
            return Outcome(step.name, "reused", left["rows"])
        try:
            seen = Observation()
            df = step.make(*(store.frame(entries[n]) for n in step.needs)).observe(seen, F.count(F.lit(1)).alias("rows"))
            entry = store.write(df, step.name, name)
            rows = seen.get["rows"]
            store.files.put_new(marker(step.name), json.dumps({"table": entry, "rows": rows}))
        except Exception as e:  # noqa: BLE001  whatever the step raises is its outcome
            return Outcome(step.name, "failed", seconds=time.time() - began, error=f"{type(e).__name__}: {str(e)[:500]}")
        entries[step.name] = entry
        return Outcome(step.name, "done", rows, time.time() - began)

    with ThreadPoolExecutor(side_by_side) as pool:
        running = {}
        while graph.is_active():
            for n in graph.get_ready():
                if any(outcomes[x].state in ("failed", "skipped") for x in by_name[n].needs):
                    outcomes[n] = Outcome(n, "skipped")
                    graph.done(n)
                else:
                    running[pool.submit(inheritable_thread_target(store.spark)(one), by_name[n])] = n
            finished = wait(running, return_when=FIRST_COMPLETED).done if running else ()
            for f in finished:
                n = running.pop(f)
                outcomes[n] = f.result()
                graph.done(n)
    result = [outcomes[s.name] for s in steps]
    if any(o.state in ("failed", "skipped") for o in result):
        raise BuildError(result)
    store.commit(name, entries, marks, base)
    return result

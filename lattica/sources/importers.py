"""Writes to stores outside Spark that happen once, however often a task is tried, and importers by name over them.

A store takes rows in two steps, as Spark's own file writers do. Tasks stage batches under the name of their attempt;
when all tasks are done, the driver publishes the attempts that Spark has committed, and what other attempts staged is
dropped. Only names and counts go to the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lattica.session import ship


class Store(Protocol):
    """What a store offers. It is pickled to the tasks, so connections belong into the methods."""

    def stage(self, attempt: str, number: int, rows: list[Row]) -> None:
        """Takes one batch of an attempt, so that nobody sees it yet."""

    def publish(self, run: str, attempts: Sequence[str]) -> None:
        """Makes the batches of these attempts visible, all or none, and those of one run once only."""

    def discard(self, run: str) -> None:
        """Drops what a failed run has staged."""


@dataclass(frozen=True)
class FolderStore:
    """Rows as lines of JSON in a folder that the driver and all executors share; a list of files for each published run."""

    folder: str

    def stage(self, attempt: str, number: int, rows: list[Row]) -> None:
        where = os.path.join(self.folder, "staged", attempt)
        os.makedirs(where, exist_ok=True)
        with open(os.path.join(where, f"{number:06d}.json"), "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) + "\n" for r in rows)

    def publish(self, run: str, attempts: Sequence[str]) -> None:
        os.makedirs(os.path.join(self.folder, "runs"), exist_ok=True)
        draft = os.path.join(self.folder, f".{run}")
        with open(draft, "w", encoding="utf-8") as f:
            f.writelines(f"{a}\n" for a in sorted(attempts))
        os.replace(draft, os.path.join(self.folder, "runs", run))  # one step: readers see the whole run or nothing of it

    def discard(self, run: str) -> None:
        pass  # files that no run lists are never read

    def files(self) -> list[str]:
        """The published files."""
        out = []
        for run in sorted(os.listdir(os.path.join(self.folder, "runs"))) if os.path.isdir(os.path.join(self.folder, "runs")) else []:
            with open(os.path.join(self.folder, "runs", run), encoding="utf-8") as f:
                for attempt in f.read().split():
                    where = os.path.join(self.folder, "staged", attempt)
                    out += [os.path.join(where, name) for name in sorted(os.listdir(where))]
        return out


@dataclass(frozen=True)
class Attempt(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, store: Store, batch: int, run: str):
        self.store, self.batch, self.run, self.rows = store, batch, run, 0

    def write(self, iterator: Iterator[Row]) -> Attempt:
        attempt, held, number, rows = f"{self.run}-{uuid.uuid4().hex}", [], 0, 0
        for row in iterator:
            held.append(row)
            rows += 1
            if len(held) == self.batch:
                self.store.stage(attempt, number, held)
                held, number = [], number + 1
        if held:
            self.store.stage(attempt, number, held)
        return Attempt(attempt, rows)

    def commit(self, messages: list[Attempt | None]) -> None:
        done = [m for m in messages if m is not None and m.rows]
        self.store.publish(self.run, [m.name for m in done])

    def abort(self, messages: list[Attempt | None]) -> None:
        self.store.discard(self.run)


#: Batch sizes of the strategies: rows together, or one by one.
STRATEGIES = {"aggregate": 1000, "transaction": 1}
_importers: dict[str, Callable[..., Store]] = {"folder": FolderStore}


def register_importer(name: str, make: Callable[..., Store]) -> None:
    """Adds an importer: a function of options that makes a store."""
    _importers[name.lower()] = make


def store(df: DataFrame, to: Store, strategy: str = "aggregate", batch: int | None = None, run: str | None = None) -> None:
    """Writes df to a store from the executors, each row once, even if tasks fail and are tried again or run twice.

    A run that is written again under its name replaces nothing and adds nothing twice, if the store keeps to `publish`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    size = batch if batch and strategy == "aggregate" else STRATEGIES[strategy]
    spark, run = ship(df.sparkSession), run or uuid.uuid4().hex

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lattica_store"

        def writer(self, schema, overwrite):
            return _Writer(to, size, run)

    spark.dataSource.register(Sink)
    df.write.format("lattica_store").mode("append").save()


def import_rows(df: DataFrame, importer: str, strategy: str = "aggregate", batch: int | None = None, run: str | None = None, **options) -> Store:
    """Writes df by a registered importer, whose name is matched in any case; the store."""
    if importer.lower() not in _importers:
        raise ValueError(f"unknown importer {importer!r}")
    to = _importers[importer.lower()](**options)
    store(df, to, strategy, batch, run)
    return to


def import_graph(graph, importer: str, folder_of: Callable[[str], dict], **how) -> dict[str, Store]:
    """Writes the nodes and then the edges of a graph, each to the store that folder_of's options for 'nodes' or 'edges' make."""
    return {part: import_rows(getattr(graph, part), importer, **how, **folder_of(part)) for part in ("nodes", "edges")}

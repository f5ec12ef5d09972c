"""Numbered snapshots of a stored model.

Data files of a snapshot are written under folders of their own and never overwritten. What makes them the current state is a
manifest, one small JSON file per snapshot, written last and moved into place under its number: a reader takes the manifest
with the highest number and reads exactly the folders that it names, so a build that breaks off leaves every reader with the
state before it. Files are reached through Spark's own file systems, wherever the path is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from marginlens.functions.textfile import file_system, read_text, write_text

_MANIFESTS = "manifests"


@dataclass
class Manifest:
    """Where the tables of a snapshot are, and what came in from its source."""

    number: int
    #: Table name to folder, from the warehouse's path.
    tables: dict[str, str] = field(default_factory=dict)
    #: Schemas of the tables, as JSON.
    schemas: dict[str, str] = field(default_factory=dict)
    #: Month folder of the fact to the snapshot that wrote it.
    months: dict[str, int] = field(default_factory=dict)
    #: Month folder to rows, net sales and cost (as text) counted on the source before the model's joins.
    control: dict[str, dict[str, str]] = field(default_factory=dict)


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, _ = file_system(spark, self.path)

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def folders(self, *parts: str) -> list[str]:
        """Names of what lies in a folder, sorted; none for a folder that is not there."""
        place = self._at(*parts)
        if not self._fs.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place))

    def numbers(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in self.folders(_MANIFESTS) if name[:1].isdigit() and name.endswith(".json"))

    def next_number(self) -> int:
        """A number above every snapshot, published or not: folders of a build that broke off are not written to again."""
        begun = [int(n.partition("=")[2]) for table in self.folders("tables") for n in self.folders("tables", table)]
        return 1 + max([0, *self.numbers(), *begun])

    def read(self, number: int | None = None) -> Manifest:
        """The manifest of a snapshot, of the newest one by default."""
        known = self.numbers()
        if not known or number not in (None, *known):
            raise FileNotFoundError(f"no {'snapshot' if number is None else f'snapshot {number}'} in {self.path}")
        name = f"{known[-1] if number is None else number}.json"
        return Manifest(**json.loads(read_text(self.spark, f"{self.path}/{_MANIFESTS}/{name}")))

    def publish(self, manifest: Manifest) -> None:
        """Make a snapshot the current one. Fails if another writer has published its number meanwhile."""
        draft, final = self._at(_MANIFESTS, f"_{manifest.number}-{uuid.uuid4().hex}.tmp"), self._at(_MANIFESTS, f"{manifest.number}.json")
        write_text(self.spark, draft.toString(), json.dumps(asdict(manifest), sort_keys=True))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"snapshot {manifest.number} of {self.path} was published by another writer")

    def prune(self, keep: int = 1) -> list[str]:
        """Delete the manifests before the last ``keep`` and every older data folder that the kept ones don't name.

        Folders newer than the newest manifest belong to a build that may still run, and stay.
        """
        known = self.numbers()
        kept = [self.read(n) for n in known[-keep:]]
        used = {folder for m in kept for folder in m.tables.values()} | {month_folder(table, month, n) for m in kept for month, n in m.months.items() for table in MONTHLY}
        dropped = []
        for table in self.folders("tables") if kept else []:
            for snapshot in self.folders("tables", table):
                place = f"tables/{table}/{snapshot}"
                inside = [f"{place}/{name}" for name in self.folders(*place.split("/"))] if table in MONTHLY else [place]
                if int(snapshot.partition("=")[2]) <= known[-1]:
                    dropped += [p for p in inside if p not in used and not p.rpartition("/")[2].startswith("_")]
        for n in known[:-keep]:
            self._fs.delete(self._at(_MANIFESTS, f"{n}.json"), False)  # first: no reader may find a manifest without its data
        for place in dropped:
            self._fs.delete(self._at(*place.split("/")), True)
        return dropped


FACT = "fact_sales"
#: Tables that are written by month: the fact, and what each of its months contributes to the quality report.
MONTHLY = (FACT, "audit_rules", "audit_usage", "audit_grain")
MONTH_FOLDER = "order_month="


def table_folder(table: str, number: int) -> str:
    return f"tables/{table}/snapshot={number}"


def month_folder(table: str, month: str, number: int) -> str:
    return f"{table_folder(table, number)}/{MONTH_FOLDER}{month}"

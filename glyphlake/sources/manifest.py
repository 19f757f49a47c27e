"""The manifest of an index: everything a reader must know, in one small immutable file per generation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from glyphlake.functions.params import IndexParams
from glyphlake.sources import files

FORMAT_VERSION = 1
#: Fixed value: an index never has more runs.
MOST_RUNS = 16
#: Fixed value: the page size by which sizes are counted.
PAGE_BYTES = 8192


@dataclass
class Part:
    """A folder of rows: row ids are the first id of the file's task plus the place in it."""

    path: str
    first: dict[str, int]  # task number: row id of its first row
    rows: int
    size: int  # bytes of indexed values
    longest: int = 0  # of them, bytes


@dataclass
class Run:
    id: int
    path: str
    rows: int
    keys: int
    size: int  # bytes of the posting lists
    stopped: int
    npages: int


@dataclass
class Manifest:
    generation: int
    column: str
    order: list[str]
    expression: str | None
    predicate: str | None
    schema: str
    params: dict[str, Any]
    parts: list[Part] = field(default_factory=list)
    pending: list[Part] = field(default_factory=list)
    frozen: list[Part] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    next_rid: int = 0
    next_run: int = 1
    npages: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # of each stream: its last batch
    version: int = FORMAT_VERSION

    @property
    def options(self) -> IndexParams:
        return IndexParams(**self.params)

    def write(self, root: str) -> None:
        files.write_json(f"{root}/manifest-{self.generation:010d}.json", asdict(self))

    @classmethod
    def read(cls, root: str, generation: int | None = None) -> Manifest:
        found = [n for n in files.names(root) if n.startswith("manifest-")]
        if not found:
            raise ValueError(f"{root} is not a pattern index")
        name = found[-1] if generation is None else f"manifest-{generation:010d}.json"
        raw = files.read_json(f"{root}/{name}")
        if raw["version"] != FORMAT_VERSION:
            raise ValueError(f"{root} has format {raw['version']}, not {FORMAT_VERSION}")
        for kind, cls_ in (("parts", Part), ("pending", Part), ("frozen", Part), ("runs", Run)):
            raw[kind] = [cls_(**x) for x in raw[kind]]
        if len(raw["runs"]) > MOST_RUNS:
            raise ValueError(f"{root} has too many runs")
        return cls(**raw)

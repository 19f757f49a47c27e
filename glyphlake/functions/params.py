"""The options of a pattern index, fixed when it is built."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

#: The ranges of the integer options.
RANGES = {
    "k": (1, 8),
    "cap": (1, 64),
    "rollup": (0, 4),
    "reverse_depth": (0, 64),
    "anchor_len": (0, 4),
    "skip_depth": (0, 8),
    "pending_limit": (0, 2147483647 // 1024),
    "rows_per_page": (1, 1 << 20),
    "long_value_limit": (0, 2147483647),
}


@dataclass(frozen=True)
class IndexParams:
    """Positions come in segments of ``k``; ``cap`` segments are indexed from the front, ``reverse_depth`` from the back.

    ``rollup`` is the longest n-gram, ``anchor_len`` the longest anchored prefix and suffix, ``skip_depth``
    the widest pair with a gap. ``exact`` keeps selective keys by row, not by page. Lists of more than
    ``stop_threshold`` of the pages are dropped. ``pending_limit`` (kB) starts a merge on insert.
    ``long_value_limit`` (bytes, 0: none) makes pending values beyond it candidates by page.
    """

    k: int = 3
    cap: int = 2
    rollup: int = 3
    reverse_depth: int = 1
    composite: bool = True
    cross_edges: bool = False
    stop_threshold: float = 0.0
    pending_limit: int = 4096
    anchor_len: int = 4
    skip_depth: int = 4
    exact: bool = True
    exact_bigrams: bool = False
    rows_per_page: int = 128
    long_value_limit: int = 0

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        if not 0.0 <= self.stop_threshold <= 1.0:
            raise ValueError("stop_threshold must be between 0.0 and 1.0")
        for name in ("composite", "cross_edges", "exact", "exact_bigrams"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")
        object.__setattr__(self, "reverse_depth", min(self.reverse_depth, self.cap))

    @classmethod
    def of(cls, **options: object) -> IndexParams:
        known = {f.name for f in fields(cls)}
        for name in options:
            if name not in known:
                raise ValueError(f'unrecognized parameter "{name}"')
        return cls(**options)  # type: ignore[arg-type]

    def as_dict(self) -> dict[str, object]:
        return asdict(self)

    def limit(self, direction: str) -> int:
        """Positions that are indexed from the front (F) or the back (R)."""
        return self.k * (self.cap if direction == "F" else self.reverse_depth)

    @property
    def stops(self) -> bool:
        return 0.0 < self.stop_threshold < 1.0

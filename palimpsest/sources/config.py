"""Configuration: 26 fields with defaults and limits, and its JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, make_dataclass, replace

PAGE = 4096


@dataclass(frozen=True)
class Config:
    """``gc_high_water_pct``, ``sync_mode`` and ``dram_cache_side`` are accepted and have no effect.

    Fixed values: names, order and defaults of the fields.
    """

    n_groups_tokens: int = 32
    region_cnt: int = 6
    region_size_pages: int = 0
    epoch_secs: int = 1800
    gc_high_water_pct: int = 10
    hot_hit_threshold: int = 64
    hot_decay_ms: int = 10000
    sync_mode: bool = False
    journal_pages: int = 512
    stripe_threshold: int = 1 << 20
    metrics_level: int = 1
    gc_start_pct: int = 80
    gc_stop_pct: int = 70
    gc_step_gens: int = 1
    min_gen_age_secs: int = 0
    evict_tomb_cap: int = 65536
    max_layers: int = 256
    batch_min_bytes: int = 256 << 10
    dram_cache_bytes: int = 256 << 20
    dram_entry_max_bytes: int = 8 << 20
    dram_alloc_backend: int = 0
    dram_cache_side: int = 0
    stripe_unit: int = 0
    region_align_bytes: int = 0
    abi_version: int = 2
    abi_size: int = 0

    def resolved(self) -> "Config":
        """With the layout's defaults for zeros."""
        return replace(self, stripe_unit=self.stripe_unit or 256 << 10, stripe_threshold=self.stripe_threshold or 1 << 20, batch_min_bytes=self.batch_min_bytes or 256 << 10, dram_entry_max_bytes=self.dram_entry_max_bytes or 8 << 20, region_align_bytes=self.region_align_bytes or PAGE)

    def problems(self) -> list[str]:
        c, out = self.resolved(), []
        for bad, what in (
            (c.abi_version > 2, "abi_version"), (not 1 <= c.max_layers <= 256, "max_layers"), (c.n_groups_tokens == 0, "n_groups_tokens"),
            (c.batch_min_bytes % PAGE != 0 or c.batch_min_bytes > c.stripe_threshold, "batch_min_bytes"), (not 0 <= c.dram_alloc_backend <= 3, "dram_alloc_backend"),
            (c.evict_tomb_cap & (c.evict_tomb_cap - 1) != 0, "evict_tomb_cap"),
        ):
            if bad:
                out.append(what)
        return out

    def validated(self) -> "Config":
        if found := self.problems():
            raise ValueError(f"EINVAL: {', '.join(found)}")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> "Config":
        known = {f.name for f in fields(cls)}
        given = json.loads(text)
        if extra := set(given) - known:
            raise ValueError(f"EINVAL: unknown fields {sorted(extra)}")
        return cls(**given).validated()


def schema_rows() -> list[tuple[int, str, str, str]]:
    """(place, name, type, default) of each field, from the dataclass."""
    return [(k, f.name, f.type, json.dumps(f.default)) for k, f in enumerate(fields(Config))]


def schema_json() -> str:
    """The fields as JSON, from which ``generated`` makes the class again."""
    return json.dumps([{"name": n, "type": t, "default": json.loads(d)} for _, n, t, d in schema_rows()])


def generated(spec: str) -> type:
    """A frozen dataclass from the JSON of its fields."""
    known = {"int": int, "bool": bool, "str": str}
    rows = json.loads(spec)
    if bad := [r["name"] for r in rows if r["type"] not in known]:
        raise ValueError(f"EINVAL: types of {bad}")
    return make_dataclass("Config", [(r["name"], known[r["type"]], field(default=r["default"])) for r in rows], frozen=True)


#: What a zero stands for, after ``Config.resolved``.
DEFAULTS = {"stripe_unit": 256 << 10, "stripe_threshold": 1 << 20, "batch_min_bytes": 256 << 10, "dram_entry_max_bytes": 8 << 20, "region_align_bytes": PAGE}


def resolved_columns() -> list:
    """The columns of ``DEFAULTS`` with defaults for zeros and nulls."""
    from pyspark.sql import functions as F

    return [F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(value)).cast("long").alias(name) for name, value in DEFAULTS.items()]


def geometry_ok(logical_block: int) -> bool:
    """A block size is not known (0), or a power of two from 512 to a page."""
    return logical_block == 0 or (512 <= logical_block <= PAGE and logical_block & (logical_block - 1) == 0)


def region_pages(usable: int, cfg: Config) -> int:
    """Pages of a region: given, or from what is usable; aligned down where that leaves 64 at least."""
    pages = cfg.region_size_pages or ((usable - 2) // cfg.region_cnt if usable > 2 else 8192)
    pages = max(64, pages)
    align = max(1, (cfg.region_align_bytes or PAGE) // PAGE)
    down = pages // align * align
    return down if down >= 64 else pages

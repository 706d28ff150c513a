"""Settings of a crawl: defaults, a user's file over them, and checks."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class CrawlConfig:
    """Times in ms, sizes in bytes. ``max_urls`` None: no limit."""

    max_urls: int | None = 10_000
    max_urls_per_authority: int = 500
    authority_delay: int = 2000
    ip_delay: int = 2000
    keepalive_time: int = 2000
    required_front_size: int = 1000
    workbench_max_byte_size: int = 512 << 20
    url_cache_max_byte_size: int = 1 << 30
    cookies_max_byte_size: int = 2048
    user_agent: str = "fathomweb"
    root_dir: str = "default-crawl"
    seed_file: str | None = None
    is_new: bool = True
    runtime_stop: bool = False

    def __post_init__(self) -> None:
        for name in ("max_urls_per_authority", "authority_delay", "ip_delay", "required_front_size", "cookies_max_byte_size"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError(f"{name} must be a whole number of at least 0, not {value!r}")
        if self.max_urls is not None and self.max_urls < 0:
            raise ValueError("max_urls must not be negative")

    @property
    def workbench_size(self) -> int:
        return self.workbench_max_byte_size // 100

    @property
    def cache_entries(self) -> int:
        return self.url_cache_max_byte_size // 64


def read_config(path: str) -> CrawlConfig:
    """A JSON or TOML file over the defaults, which it overrides. Paths become absolute.

    Errors: unknown settings; a new crawl whose root isn't empty; a continued one without root; a missing seed file.
    """
    file = Path(path)
    found = tomllib.loads(file.read_text()) if file.suffix == ".toml" else json.loads(file.read_text())
    unknown = set(found) - {f.name for f in fields(CrawlConfig)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    config = CrawlConfig(**found)
    root = Path(config.root_dir).absolute()
    if config.is_new and root.exists() and any(root.iterdir()):
        raise ValueError(f"{root} is not empty")
    if not config.is_new and not root.exists():
        raise ValueError(f"{root} does not exist")
    seeds = Path(config.seed_file).absolute() if config.seed_file else None
    if seeds is not None and not seeds.exists():
        raise ValueError(f"{seeds} does not exist")
    return replace(config, root_dir=str(root), seed_file=str(seeds) if seeds else None)

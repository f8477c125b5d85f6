"""Job options and the fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -------------------------------------------------------
SCOPES = ("same_domain", "same_site", "allowlist", "all")
NODE_STATUSES = ("queued", "crawling", "ok", "error", "blocked", "skipped", "need_human")
QUEUE_STATES = ("pending", "running", "done", "failed", "skipped")
SCHEMA_VERSION = "1.0"
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class CrawlOptions:
    """What a crawl over stored pages follows.

    None switches a budget off; ``guards=False`` switches all of them off.
    Values are taken as they are: what can't be meant is an error.
    """

    max_depth: int = 5
    max_pages: int | None = None
    visit_limit: int | None = 3
    prefix_prune_threshold: int | None = 20
    pagination_page_limit: int | None = 50
    respect_robots: bool = True
    drop_www: bool = True
    force_https: bool = False
    tracking_blacklist: tuple[str, ...] = field(default_factory=tuple)
    guards: bool = True

    def __post_init__(self) -> None:
        for name, least in (("max_depth", 0), ("max_pages", 1), ("visit_limit", 1), ("prefix_prune_threshold", 1), ("pagination_page_limit", 1)):
            value = getattr(self, name)
            if value is None and name != "max_depth":
                continue
            if not isinstance(value, int) or value < least:
                raise ValueError(f"{name} is {value!r}; it must be a whole number of at least {least}")

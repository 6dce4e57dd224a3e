"""What a server around the engines decides on the driver; nothing here touches a table's rows."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from time import sleep
from typing import Any, Generic, TypeVar

from pyspark.sql import SparkSession

V = TypeVar("V")

# Providers that may be asked for, and the models shown where a provider's list can't be had.
PROVIDERS = ("ollama", "openai", "none")
FALLBACK_MODELS = ["gpt-4o-mini", "gpt-4.1-mini"]


class ResultCache(Generic[V]):
    """Q21: at most ``size`` results by key; a full cache gives up its oldest entry, however often it
    was read. Threads may share it; a result is made outside the lock."""

    def __init__(self, size: int = 200):
        self.size, self._held, self._lock = size, dict[Hashable, V](), Lock()

    def get(self, key: Hashable, make: Callable[[], V]) -> V:
        with self._lock:
            if key in self._held:
                return self._held[key]
        value = make()
        with self._lock:
            if key not in self._held:
                while len(self._held) >= self.size:
                    del self._held[next(iter(self._held))]
                self._held[key] = value
            return self._held[key]

    def __len__(self) -> int:
        return len(self._held)


def resolve_provider(requested: str, probe: Callable[[], Any], key: str = "") -> str:
    """Q19: the provider asked for if it is known; else the local one if ``probe`` doesn't raise, the
    remote one if there is a key, or none."""
    if requested in PROVIDERS:
        return requested
    try:
        probe()
    except Exception:  # any failure to reach it means that it isn't there
        return "openai" if key else "none"
    return "ollama"


def models(provider: str, listed: Callable[[], Iterable[str]], own: str, most: int = 30) -> dict[str, Any]:
    """Q24: the models to choose from. ``listed`` asks the provider and may raise; ``own`` is the
    configured local model."""
    if provider == "none":
        return {"models": [], "provider": "none"}
    try:
        names = list(listed())
    except Exception:  # any failure of the provider's list
        return {"models": FALLBACK_MODELS if provider == "openai" else [own], "provider": provider, "fallback": True}
    if provider == "openai":
        names = sorted({n for n in names if n.startswith("gpt-")})[:most] or FALLBACK_MODELS[:1]
    return {"models": names, "provider": provider}


def fetched(get: Callable[[str], str], url: str, tries: int = 3, base: float = 1.5, wait: Callable[[float], Any] = sleep) -> str | None:
    """The text that ``get`` gives for a URL, asked up to ``tries`` times with growing pauses;
    null if it never answers."""
    for attempt in range(tries):
        try:
            return get(url)
        except Exception:  # whatever the client raises counts as no answer
            if attempt < tries - 1:
                wait(base**attempt)
    return None


def run_groups(spark: SparkSession, groups: dict[str, list[Callable[[SparkSession], Any]]]) -> dict[str, list[Any]]:
    """ST6: groups of jobs side by side, the jobs of one group in order, each group in a scheduler
    pool of its name. The first error is raised when all groups have ended."""

    def one(name: str) -> list[Any]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return [job(spark) for job in groups[name]]

    with ThreadPoolExecutor(max(1, len(groups))) as pool:
        running = {name: pool.submit(one, name) for name in groups}
    return {name: f.result() for name, f in running.items()}

"""Runs a named query from the command line, and calls functions with settings from the configuration and overrides.

    python -m marlstone.runner tfidf_top_terms --data /data/sf1 --out /data/top
"""

from __future__ import annotations

import argparse
import dataclasses
import inspect
import json
import logging
import time
from collections.abc import Callable
from typing import Any

from marlstone.config import Config

log = logging.getLogger("marlstone")


def configure_logging(level: str = "INFO", path: str | None = None) -> None:
    """Log to the console, and to a file if one is named; calling it again changes the level and adds nothing twice."""
    log.setLevel(level.upper())
    wanted: list[logging.Handler] = [logging.StreamHandler()] + ([logging.FileHandler(path)] if path else [])
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in wanted:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)


def _read(text: str, like: Any) -> Any:
    """A setting as the type of its default: JSON for lists, null for None, plain text for strings."""
    if text == "null":
        return None
    if isinstance(like, bool):
        return text.lower() in ("1", "true", "yes")
    if isinstance(like, str):
        return text
    return type(like)(text) if isinstance(like, (int, float)) else json.loads(text)


def configured(settings: dict[str, Any] | None = None, overrides: list[str] | None = None) -> Config:
    """The defaults with a dictionary of settings and then ``name=value`` texts applied; unknown names are an error."""
    values = dataclasses.asdict(Config())
    for name, value in (settings or {}).items():
        if name not in values:
            raise ValueError(f"no setting {name}")
        values[name] = value
    for text in overrides or []:
        name, sign, value = text.partition("=")
        if not sign or name not in values:
            raise ValueError(f"no setting {name}")
        values[name] = _read(value, values[name])
    return Config(**values)


def call_with(f: Callable[..., Any], config: Config, **given: Any) -> tuple[Any, float]:
    """The result and seconds of a call whose parameters come from ``given``, else from the configuration, else from defaults."""
    names = inspect.signature(f).parameters
    known = dataclasses.asdict(config)
    chosen = {n: known[n] for n in names if n in known} | {n: v for n, v in given.items() if n in names}
    began = time.time()
    log.info("%s starts", getattr(f, "__name__", f))
    out = f(**chosen)
    took = time.time() - began
    log.info("%s took %.1f s", getattr(f, "__name__", f), took)
    return out, took


def main(argv: list[str] | None = None) -> float:
    """Run one query over a data directory and write its rows as Parquet; returns the seconds."""
    from marlstone.plans import all_registries
    from marlstone.session import get_session, release

    queries = {n: f for r in all_registries() for n, f in r.queries.items()}
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("query", choices=sorted(queries))
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--cores", default="*")
    p.add_argument("--log", default=None)
    a = p.parse_args(argv)
    configure_logging(path=a.log)
    spark = get_session("runner", a.cores)

    def run() -> None:
        queries[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)

    run.__name__ = a.query
    took = call_with(run, Config())[1]
    release(spark)
    return took


if __name__ == "__main__":
    main()

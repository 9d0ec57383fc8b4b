"""Named queries; load_all() registers them."""

import importlib

MODULES = ("metrics", "traces", "relations", "texts", "streams", "scalars", "sessions", "joint", "timing", "rulesets", "scans", "queues", "lanes")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"riverbed.plans.{name}")

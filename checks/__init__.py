"""Registered queries with their SQL, and the tool that compares the two."""

import importlib

TOPICS = ["reports", "views", "suggestions", "receipts", "workflow", "changes", "streams", "files"]


def load_all() -> None:
    for topic in TOPICS:
        importlib.import_module(f"checks.{topic}")

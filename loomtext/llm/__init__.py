"""Operators for building training data from text; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

NAMES = ["chunking", "textstats", "sentences", "langid", "mojibake", "truncation", "packing", "mixing"]


def query_modules() -> list:
    return [importlib.import_module(f"loomtext.llm.{name}") for name in NAMES]

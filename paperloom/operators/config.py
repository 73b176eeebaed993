"""Rules of the classifier and how they are resolved, as plain driver-side values."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import BENEFICIAL_PAIRS, GAP_THRESHOLD, LABELS


@dataclass(frozen=True)
class Rules:
    """Label schema of a classifier: labels, gap threshold, pairs that are always reranked, model name."""

    labels: tuple[str, ...] = LABELS
    threshold: float = GAP_THRESHOLD
    pairs: tuple[tuple[str, str], ...] = BENEFICIAL_PAIRS
    model_name: str = ""
    status: dict = field(default_factory=dict)


def rules_from_json(text: str) -> Rules:
    """K1: missing keys become 0.0, none and empty; pairs that are not two names are skipped."""
    data = json.loads(text)
    pairs = tuple((str(p[0]), str(p[1])) for p in data.get("beneficial_pairs", []) if isinstance(p, list) and len(p) == 2)
    return Rules(tuple(data.get("labels", [])), float(data.get("optimal_gap_threshold", 0.0)), pairs, str(data.get("model_name", "")))


def resolve_model_name(argument: str | None, setting: str | None, schema: str) -> str:
    """K2: the first that is not blank of argument, job setting and schema."""
    return next((x.strip() for x in (argument, setting) if x and x.strip()), schema)


def cache_key(remote: bool, model_name: str) -> str:
    """K3: rules are kept by backend and model."""
    return f"{'remote' if remote else 'local'}:{model_name}"


def resolve_rules(default: Rules, model_name: str, tuned: dict[str, Rules]) -> Rules:
    """The default model has the default rules; another one the tuned rules, if there are any."""
    return default if model_name == default.model_name else tuned.get(model_name, default)


def use_remote(argument: bool | None, setting: str | None) -> bool:
    """K5: the argument, else whether the job setting names the remote backend."""
    return argument if argument is not None else (setting or "").strip().lower() == "remote"


def first_setting(names: tuple[str, ...], settings: dict[str, str]) -> str:
    """K8: the first of the named job settings that is not blank, else empty. Settings are given, never read from the process."""
    return next((settings[n].strip() for n in names if settings.get(n, "").strip()), "")


@dataclass
class TableSummariser:
    """K6, K7: which backend summarises tables, and one instance of it a Python worker.

    ``make(model_name, token)`` builds the backend on the worker that first needs it. Without a token
    there is no backend, and ``column`` is None, so that summarise_tables keeps to its local summary.
    """

    make: Callable[[str, str], Callable[[str], str]]
    model_name: str
    token: str

    @property
    def column(self) -> Callable[[Column], Column] | None:
        if not self.token:
            return None
        make, model_name, token, held = self.make, self.model_name, self.token, []

        @F.pandas_udf("string")
        def summarise(tables: pd.Series) -> pd.Series:
            if not held:
                held.append(make(model_name, token))
            return tables.map(held[0], na_action="ignore")

        return summarise

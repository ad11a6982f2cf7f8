"""The extension surface: named checks that add findings, and a user's own scoring function with errors kept per row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "media_id bigint, check_id string, stage string, title string, status string, severity string, evidence_class string, detail string, llr double, llr_cap double"
_COLUMNS = [c.split()[0] for c in FINDING.split(", ")]
_TYPES = dict(c.split() for c in FINDING.split(", "))


class CheckRegistry:
    """Checks by modality and phase. A check takes the media DataFrame and returns finding rows; missing finding columns are NULL."""

    def __init__(self) -> None:
        self._checks: dict[tuple[str, str], dict[str, Callable[[DataFrame], DataFrame]]] = {}

    def register(self, modality: str, check_id: str, phase: str = "pre"):
        """Decorator; registering a check_id again replaces the old check."""

        def add(fn):
            group = self._checks.setdefault((modality, phase), {})
            group.pop(check_id, None)
            group[check_id] = fn
            return fn

        return add

    def run(self, df: DataFrame, modality: str, phase: str = "pre") -> DataFrame:
        """Union of all findings. A check that cannot be planned gives one ERROR finding per media and the others still run; for bad rows a
        check uses try_ expressions and reports the NULL it gets."""
        parts = []
        for check_id, fn in self._checks.get((modality, phase), {}).items():
            try:
                found = fn(df)
                found.schema  # noqa: B018 - plans the check now, so that its errors are seen here
                parts.append(_conform(found, check_id))
            except Exception as exc:  # noqa: BLE001 - isolation is the point
                parts.append(_failed(df, check_id, f"{type(exc).__name__}: {str(exc)[:200]}"))
        out = df.sparkSession.createDataFrame([], FINDING) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _conform(found: DataFrame, check_id: str) -> DataFrame:
    have = set(found.columns)
    cols = []
    for name in _COLUMNS:
        base = F.col(name) if name in have else F.lit(check_id) if name in ("check_id", "title") else F.lit(None)
        cols.append(base.cast(_TYPES[name]).alias(name))
    return found.select(*cols)


def _failed(df: DataFrame, check_id: str, detail: str) -> DataFrame:
    fixed = {"check_id": check_id, "title": check_id, "stage": "errors", "status": "ERROR", "severity": "NONE", "evidence_class": "RELIABILITY", "detail": detail}
    return df.select(*[F.col("media_id").cast("bigint") if n == "media_id" else F.lit(fixed.get(n)).cast(_TYPES[n]).alias(n) for n in _COLUMNS])


def score_files(df: DataFrame, scorer: Callable[[dict], dict], key: str = "path") -> DataFrame:
    """(key, label, ai_pct, success, error, latency_s): the user's function per row, on Arrow batches; an exception becomes an error row.

    ``scorer`` gets a row as a dict and returns a dict with label and ai_percentage (and optionally error).
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record in pdf.to_dict("records"):
                start = time.perf_counter()
                try:
                    res = scorer(record)
                    error = res.get("error")
                    rows.append((record[key], res.get("label"), res.get("ai_percentage"), not error, error, time.perf_counter() - start))
                except Exception as exc:  # noqa: BLE001 - one bad file must not stop the rest
                    rows.append((record[key], None, None, False, f"{type(exc).__name__}: {exc}"[:200], time.perf_counter() - start))
            yield pd.DataFrame(rows, columns=[key, "label", "ai_pct", "success", "error", "latency_s"])

    return df.mapInPandas(run, f"{key} {kind}, label string, ai_pct double, success boolean, error string, latency_s double")

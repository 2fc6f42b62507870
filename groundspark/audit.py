"""Audit lines and governed export."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import csv_safe


class AuditLog:
    """JSON lines with a digest and length in place of text; rotated by size; readable by the owner only."""

    def __init__(self, path: str, most_bytes: int = 20 << 20, keep: int = 10):
        self.path, self.most, self.keep = Path(path), most_bytes, keep

    def write(self, user: str, role: str, action: str, outcome: str, text: str, **more) -> dict:
        line = {"time": time.time(), "user": user, "role": role, "action": action, "outcome": outcome, "sha256": hashlib.sha256(text.encode()).hexdigest(), "length": len(text)} | more
        if self.path.exists() and self.path.stat().st_size > self.most:
            for i in range(self.keep - 1, 0, -1):
                if (p := Path(f"{self.path}.{i}")).exists():
                    p.replace(f"{self.path}.{i + 1}")
            self.path.replace(f"{self.path}.1")
            Path(f"{self.path}.{self.keep + 1}").unlink(missing_ok=True)
        fd = os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
        with os.fdopen(fd, "a") as f:
            f.write(json.dumps(line) + "\n")
        return line


def to_csv(df: DataFrame, cap: int) -> str:
    """A capped result as CSV text with a byte-order mark; cells that look like formulas are quoted."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    safe = df.select(*[csv_safe(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns]).limit(cap)
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(df.columns)
    w.writerows(tuple(r) for r in safe.collect())  # at most cap rows
    return "﻿" + out.getvalue()

"""Fingerprints of plain data on the driver, and of columns."""

from __future__ import annotations

import base64
import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from indexflow.codec import plain


def fingerprint(value: Any) -> str:
    """Blake2b of 128 bits over canonical JSON, in base64."""
    text = json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
    return base64.b64encode(hashlib.blake2b(text.encode(), digest_size=16).digest()).decode()


def row_fingerprint(*columns: str | Column) -> Column:
    """A digest of columns of any types; nulls count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

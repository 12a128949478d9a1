"""Identities of configurations."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def config_digest(config: dict) -> str:
    """12 hex digits of the sha256 of the configuration as JSON with sorted keys; other values count as their text."""
    text = json.dumps(config, default=str, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else config_digest(json.loads(t)) for t in texts.to_pylist()], pa.string())


def json_digest(text: Column) -> Column:
    """The digest of a configuration that is given as JSON, whatever the order of its keys and its spaces."""
    return F.arrow_udf(_digests, StringType())(text)

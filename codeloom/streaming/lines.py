"""Parsing rules over a stream of files.

Parsing has no state between files, so a streaming DataFrame of files goes
through the same expressions as a batch one; sinks are the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import parse


def stream_findings(files: DataFrame) -> DataFrame:
    """A stream of (file_id, relative_path, language, source) -> a stream of findings, as operators.parse.findings()."""
    return parse.findings(files)

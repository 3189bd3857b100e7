"""Cell cleaning over many columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import text


def clean_cells(df: DataFrame, cells: list[str], nfc_cells: list[str] | None = None) -> DataFrame:
    """NFC, strip, blank to NULL, spreadsheet errors and NA tokens to NULL, each step a projection.

    ``nfc_cells`` limits the Unicode step to the columns known to need it; default is all.
    """
    wanted = set(cells if nfc_cells is None else nfc_cells)
    formed = df.select(*[
        text.nfc(F.col(c)).alias(c) if c in wanted and c in cells else F.col(c) for c in df.columns])
    stripped = formed.select(*[text.strip_cell(c).alias(c) if c in cells else F.col(c) for c in df.columns])
    return stripped.select(*[text.tokens_to_null(F.col(c)).alias(c) if c in cells else F.col(c) for c in df.columns])

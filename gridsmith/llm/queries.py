"""All queries of the subpackage and their SQL counterparts."""

from importlib import import_module

from gridsmith.llm.base import ORACLES, QUERIES

for _name in ("byte_pairs", "decontamination", "fingerprints", "language_id", "licenses", "line_dedup", "mixing", "near_dedup", "quality", "resampling", "suffix_dedup", "vector_codes", "warc"):
    import_module(f"gridsmith.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]

"""The queries of this package, by name, and the SQL that some can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import collapse, language, oracle, pack, prose, repeats, residue, segment, sitetree, tokenize, unify


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": prose.found,
        "p1_statistics": prose.page_statistics,
        "p2_found": language.found,
        "p2_languages": language.page_languages,
        "p10_found": residue.found,
        "p10_reasons": residue.reasons,
        "p3_found": repeats.found,
        "p4_found": sitetree.found,
        "p3_pages": repeats.cleaned,
        "p5_found": segment.found,
        "p6_found": collapse.found,
        "p7_found": unify.found,
        "p8_ids": tokenize.ids,
        "p9_containers": pack.containers,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_found": oracle.repeated_lines(), "p3_pages": oracle.cleaned_pages(), "p6_found": oracle.copies(), "p7_found": oracle.disguised()}

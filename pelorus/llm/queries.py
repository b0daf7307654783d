"""Queries of the text and linkage problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from pelorus.llm import components, leakage, linkage, survivor, tokenize, toxic
from pelorus.plans.runtime import table


def p8_ids(spark, sf_dir):
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (components.p3_found, components.p3_levels, linkage.p4_found, linkage.p4_pairs, linkage.p4_reliability, survivor.p5_found, survivor.p5_currency, p8_ids, leakage.p9_found, leakage.p9_leaks, toxic.p10_found, toxic.p10_scores, toxic.p10_rates)}

SQL: dict[str, str] = {"p3_found": components.P3_SQL, "p3_levels": components.P3_SQL, "p5_found": survivor.P5_SQL, "p5_currency": survivor.P5_CURRENCY_SQL}

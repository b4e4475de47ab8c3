"""All registered queries outside the llm subpackage, by name. Doubles are rounded to six decimals."""

from __future__ import annotations

from axisgauge.plans import audit_queries, calibration_queries, judge_queries, protocol_queries, report_queries, text_queries

FLAGSHIP = "ge4_interior_error_by_model"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (calibration_queries, judge_queries, protocol_queries, text_queries, audit_queries, report_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE

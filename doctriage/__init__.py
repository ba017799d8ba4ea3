"""Document triage and field extraction on Spark."""

from doctriage.operators.classify import classify, probabilities_by_row, rule_hits, score_by_table, top_by_row
from doctriage.operators.invoice import ExtractOptions, extract_invoice, with_invoice
from doctriage.operators.passport import extract_passport, with_passport
from doctriage.operators.rename import plan_renames
from doctriage.operators.rule_index import score_by_index
from doctriage.operators.ticket import with_ticket
from doctriage.plans.analyze import analyze, store_results, with_move_errors, with_renames
from doctriage.plans.report import report_rows, result_json, write_json, write_outputs, write_report
from doctriage.sources.rules import Rules

__all__ = [
    "ExtractOptions",
    "Rules",
    "analyze",
    "classify",
    "extract_invoice",
    "extract_passport",
    "plan_renames",
    "probabilities_by_row",
    "report_rows",
    "result_json",
    "rule_hits",
    "score_by_index",
    "score_by_table",
    "store_results",
    "top_by_row",
    "with_invoice",
    "with_move_errors",
    "with_passport",
    "with_renames",
    "with_ticket",
    "write_json",
    "write_outputs",
    "write_report",
]

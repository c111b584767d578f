"""Readers for pages, rule tables and check reports."""
from .html_nodes import parse_html
from .page_tree import parse_pages
from .reports import read_check_report, read_queue_csv, read_rules_jsonl

__all__ = ["parse_html", "parse_pages", "read_check_report", "read_queue_csv", "read_rules_jsonl"]

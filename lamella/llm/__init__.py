"""Operators for preparing large text corpora: tokenising, extraction, deduplication, scoring, packing.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface;
``queries`` derives the digest tables that the driver compares.
"""

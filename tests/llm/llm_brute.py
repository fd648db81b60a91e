"""Brute-force versions that several test files use."""

from test_pii import base as base_pii
from test_quality import base as base_quality
from test_simhash import components as simhash_components
from test_simhash import slow as simhash_print

__all__ = ["base_pii", "base_quality", "simhash_components", "simhash_print"]

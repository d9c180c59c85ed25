"""Importing this module enters every query."""

from texloom.plans import catalogue, checks, colours, decoding, derived, outcomes, pixels, runs, validation  # noqa: F401
from texloom.plans.registry import QUERIES, SQL  # noqa: F401

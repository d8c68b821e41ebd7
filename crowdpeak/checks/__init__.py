"""Registered queries over the driver tables, each with the SQL an independent engine runs for comparison."""

from crowdpeak.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

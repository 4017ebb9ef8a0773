"""All named queries of the engine and their reference SQL."""

from loomgraph.plans import analysis, graph, knowledge, networks, texts
from loomgraph.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analysis", "graph", "knowledge", "networks", "texts"]

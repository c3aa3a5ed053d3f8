"""Tables of a property graph and their schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "kgraph_id long, id long, type string, name string, uri string, created long, tags array<string>, synonyms array<string>, props map<string,string>, seq long"
EDGES = "kgraph_id long, id long, src long, dst long, type string, directed boolean, props map<string,string>, seq long"
EVENTS = "seq long, kgraph_id long, kind string, oper string, entity_id long"

# The declared vocabularies.
NODE_TYPES = ("article", "compound", "concept", "disease", "drug", "gene", "ligand", "phenotype", "protein", "query", "target")
EDGE_TYPES = ("assertion", "hypothesis", "relationship", "resolve")
EVIDENCE_TYPES = ("experiment", "literature", "statement")


def entity_id(kgraph_id: Column, key: Column) -> Column:
    """A stable id: the same key in the same graph always has the same one."""
    return F.xxhash64(kgraph_id, key)

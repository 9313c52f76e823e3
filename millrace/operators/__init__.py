"""Relational operators over the tables of a code-knowledge graph and over ranked lists."""

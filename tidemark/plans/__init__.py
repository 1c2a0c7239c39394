"""Fixture derivations, registered queries and their SQL twins."""

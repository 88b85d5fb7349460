"""Relational and imperative operators."""

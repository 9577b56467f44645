"""Relational, statistical and learned operators."""

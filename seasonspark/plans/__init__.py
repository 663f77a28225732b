"""Registered queries over the star schema, each beside its SQL."""

"""Readers and writers for builds, ratings, concordances, supply tables, scenarios and results."""

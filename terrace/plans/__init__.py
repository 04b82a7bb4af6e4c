"""Registered queries: operators bound to the shared test tables, each with its SQL."""

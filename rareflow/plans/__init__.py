"""Registered queries: every operator on the test tables, with its SQL twin."""

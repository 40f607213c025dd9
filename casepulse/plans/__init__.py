"""Registered queries: the reports bound to the test tables, and their SQL checks."""

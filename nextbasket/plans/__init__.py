"""Registered queries over the test tables, with SQL for most."""

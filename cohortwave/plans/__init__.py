"""Queries of the library's operators on the driver's tables, with SQL for the same rows."""

"""Change log, lake tables, serving tables and JSON lines."""

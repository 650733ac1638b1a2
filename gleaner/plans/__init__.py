"""Whole runs as compositions of operators: discover, read, gate, record, publish."""

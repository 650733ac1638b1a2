"""Relational operators: selections, joins, aggregates, sequences, documents, ledger state."""

"""tapewright: market-research analytics as Spark table-to-table operators."""

"""Sources and sinks: Markdown documents, recipes, test-table adapters, catalogue merges."""

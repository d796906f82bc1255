"""Code retrieval and code-graph analytics as DataFrame operators."""

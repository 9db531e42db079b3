"""DataFrame operators: labels, features, statistics, metrics, retrieval, review."""

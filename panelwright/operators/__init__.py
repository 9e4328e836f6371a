"""Panel operators: change, anomalies, trends, quality, comparison, ranking, clusters."""

"""DataFrame operators: joins, aggregations, windows, sets and anchors."""

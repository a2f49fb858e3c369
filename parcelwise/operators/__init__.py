"""DataFrame operators: growth, quantile, spatial, numbering, filters, enrichment."""

"""Jobs put together from operators: enrichment steps, and the registered queries with their SQL counterparts."""

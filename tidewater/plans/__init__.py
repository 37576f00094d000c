"""Plan-level helpers: shared storage between jobs, checked broadcasts, the query registry."""

"""Plan-level building blocks: global positions, skew-safe joins, shared scratch space, composed jobs."""

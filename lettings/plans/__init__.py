"""Named pipelines: silver tables, star, marts, scores and serving reads."""

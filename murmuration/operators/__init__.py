"""Models, resamplers, partitioned schemes, filters and statistics."""

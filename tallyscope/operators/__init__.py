"""DataFrame -> DataFrame operators; columns and thresholds are parameters."""

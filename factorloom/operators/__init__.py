"""DataFrame -> DataFrame operators; parameters carry the research defaults."""

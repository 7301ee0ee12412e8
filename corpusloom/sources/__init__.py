"""Sources and sinks: CSV, JSON lines, vectors, notes, document trees, works of bibliographic services, projects."""

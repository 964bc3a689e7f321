"""Table readers, sinks and the binding to the shared test tables."""

"""Table readers and the bindings of the test tables."""

"""CSV readers, catalog listings and small local frames."""

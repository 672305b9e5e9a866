"""DataFrame-to-DataFrame operators on keyed series."""

"""DataFrame-to-DataFrame operators built from the column expressions."""

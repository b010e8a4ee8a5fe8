"""DataFrame-to-DataFrame operators; keys, columns and parameters are arguments."""

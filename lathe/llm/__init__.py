"""Training-data operators; optional: nothing outside this subpackage imports it."""

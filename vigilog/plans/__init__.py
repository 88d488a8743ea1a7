"""Data products composed from operators, and the registered queries."""

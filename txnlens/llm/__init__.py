"""Operators that prepare a training corpus: one module each, their queries in `queries`."""

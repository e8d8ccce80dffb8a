"""Column functions: pure Catalyst expressions, and the few Arrow functions that have no such form."""

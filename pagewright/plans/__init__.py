"""Physical planning helpers shared by the operators."""

"""End-to-end runs composed of the operators."""

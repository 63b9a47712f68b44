"""Package of the element and drawing engine."""

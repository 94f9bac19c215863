"""Report plans and the end-to-end schedule built from the operators."""

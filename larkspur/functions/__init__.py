"""Values, kinds and the compilation of expressions."""

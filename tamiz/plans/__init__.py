"""Ready plans composed from the operators."""

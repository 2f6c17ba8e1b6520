"""Relations derived from an index, shared by the operators."""

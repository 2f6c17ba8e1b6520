"""Code navigation over a pre-built index of a source tree, as DataFrame plans."""

"""lamina: document structuring, chunking and corpus operators expressed as Spark plans."""

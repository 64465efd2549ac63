"""PDF files as a stream."""

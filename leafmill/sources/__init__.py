"""PDF files and images as tables."""

"""A reader for PDF files: objects, content streams, fonts and text, run inside Arrow batches."""

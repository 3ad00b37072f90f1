"""What becomes of a result: JSON, text, HTML, narrative."""

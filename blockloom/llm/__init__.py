"""Training-data operators on text, pages and vectors; nothing else in the library imports them."""

"""Operators that prepare text, page and vector corpora for training; nothing else in the library imports them."""

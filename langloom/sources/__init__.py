"""Readers and writers: text tables, benchmark cases, model files, the language registry."""

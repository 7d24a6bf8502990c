"""Views of the given tables as image relations."""

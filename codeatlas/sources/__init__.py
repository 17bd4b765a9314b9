"""File sources, text reading with limits, and evaluation sessions."""

from . import patterns, text, html, hashing  # noqa: F401

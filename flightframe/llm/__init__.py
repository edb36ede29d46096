"""Operators for preparing large text collections, written for the project's own records:
annotation files (``path``, ``xml``), release files (``path``, ``text``), frame payloads
(``url``, ``payload``), session exchanges and frames. Nothing outside this package imports it."""

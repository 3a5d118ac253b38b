"""Training-data operators (secret scan, language id, decontamination, dedup, ...).

Nothing outside this subpackage imports it; it can be deleted on its own.
"""

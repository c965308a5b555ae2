"""Training-data operators over a corpus of documents (doc_id, text, ...).

Nothing outside this subpackage imports it. All operators read only the columns that they name, so extra
columns never clash with theirs.
"""

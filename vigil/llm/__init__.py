"""Operators for preparing training data at scale.

Every operator works on a documents table (``doc_id``, ``text`` and any other
columns).  Shared conventions:

* a null text counts as empty, a null ``doc_id`` sorts first;
* rows with the same ``doc_id`` and the same text are one document and get
  the same answer; rows that share only the ``doc_id`` are ordered by a hash
  of their text;
* extra columns are never read, whatever their names.
"""
